"""Column names and catalogs shared by the operators."""

from __future__ import annotations

EPS_BASIC = "basic_earnings_loss_per_share_from_continuing_and_discontinued_operations"
EPS_DILUTED = "diluted_earnings_loss_per_share_from_continuing_and_discontinued_operations"
REVENUE = "revenue_from_operations"
PAT = "profit_loss_for_period"
PBT = "profit_before_tax"
FINANCE = "finance_costs"
DEPRECIATION = "depreciation_depletion_and_amortisation_expense"
OCF = "cash_flows_from_used_in_operating_activities"
OCF_ALIAS = "cash_flows_from_used_in_operations"
CAPEX = "payments_for_purchase_of_noncurrent_assets"
CASH = "cash_and_cash_equivalents"
BANK = "bank_balance_other_than_cash_and_cash_equivalents"
PAID_UP = "paid_up_value_of_equity_share_capital"
FACE = "face_value_of_equity_share_capital"

# Identity of a statement row and of a merged period record.
STATEMENT_KEY = ["symbol", "source", "consolidated", "filing_type", "period_end_date"]
SERIES_KEY = ["symbol", "source", "consolidated"]

# Columns kept by the default projection of every statement.
IDENTITY_KEEP = [
    "symbol", "period_end_date", "period_start_date", "xbrl_url",
    "consolidated", "fiscal_period", "filing_type", "data_quality",
]

# Priority columns per statement.
PRIORITY = {
    "income_statements": [
        REVENUE, "cost_of_revenue", "other_income", "income", FINANCE, DEPRECIATION,
        "other_expenses", "expenses", "operating_income", "exceptional_items_before_tax",
        PBT, "tax_expense", "profit_loss_for_period_from_continuing_operations",
        "profit_loss_from_discontinued_operations_after_tax", PAT,
        "profit_or_loss_attributable_to_owners_of_parent", "comprehensive_income_for_the_period",
        EPS_BASIC, EPS_DILUTED, "weighted_average_shares_basic", "weighted_average_shares_diluted",
    ],
    "balance_sheets": [
        "equity_share_capital", "other_equity", "stockholders_equity", "total_equity_including_nci",
        "total_equity", "minority_interest", "noncurrent_liabilities", "current_liabilities",
        "borrowings_current", "borrowings_noncurrent", "noncurrent_investments",
        "deferred_tax_assets_net", "noncurrent_assets", "capital_work_in_progress", "goodwill",
        "other_intangible_assets", "assets", "assets_current", "inventories",
        "trade_receivables_current", "trade_payables", CASH, BANK,
    ],
    "cash_flows": [
        OCF, "cash_flows_from_used_in_investing_activities",
        "cash_flows_from_used_in_financing_activities", CAPEX, "dividends_paid",
    ],
    "shareholdings": [
        "promoters_and_promoter_group", "foreign_institutional_investors",
        "domestic_institutional_investors", "public_shareholding", "non_institutions",
        "non_promoter_non_public_shareholding",
    ],
}

# Balance columns a ratio-only stub filing carries.
STUB_BALANCE = [PAID_UP, FACE, "debt_equity_ratio"]

# Data source and the country it serves.
SOURCE_COUNTRY = {"NSE": "in", "SEC": "us"}

# Filing tag catalog, (category, tag[, column when it is not the snake-cased tag]).
TAG_CATALOG = [
    ("metadata", "Symbol"),
    ("metadata", "toDate", "to_date"),
    ("income_statement", "RevenueFromOperations"),
    ("income_statement", "OtherIncome"),
    ("income_statement", "Income"),
    ("income_statement", "FinanceCosts"),
    ("income_statement", "DepreciationDepletionAndAmortisationExpense"),
    ("income_statement", "OtherExpenses"),
    ("income_statement", "Expenses"),
    ("income_statement", "ProfitBeforeExceptionalItemsAndTax"),
    ("income_statement", "ExceptionalItemsBeforeTax"),
    ("income_statement", "ProfitBeforeTax"),
    ("income_statement", "CurrentTax"),
    ("income_statement", "DeferredTax"),
    ("income_statement", "TaxExpense"),
    ("income_statement", "ProfitLossForPeriodFromContinuingOperations"),
    ("income_statement", "ProfitLossFromDiscontinuedOperationsBeforeTax"),
    ("income_statement", "TaxExpenseOfDiscontinuedOperations"),
    ("income_statement", "ProfitLossFromDiscontinuedOperationsAfterTax"),
    ("income_statement", "ProfitLossForPeriod"),
    ("income_statement", "ProfitOrLossAttributableToOwnersOfParent"),
    ("income_statement", "ComprehensiveIncomeForThePeriod"),
    ("balance_sheet", "PaidUpValueOfEquityShareCapital"),
    ("balance_sheet", "FaceValueOfEquityShareCapital"),
    ("balance_sheet", "EquityShareCapital"),
    ("balance_sheet", "OtherEquity"),
    ("balance_sheet", "DebtEquityRatio"),
    ("balance_sheet", "NoncurrentLiabilities"),
    ("balance_sheet", "BorrowingsCurrent"),
    ("balance_sheet", "BorrowingsNoncurrent"),
    ("balance_sheet", "NoncurrentInvestments"),
    ("balance_sheet", "TradeReceivablesNoncurrent"),
    ("balance_sheet", "LoansNoncurrent"),
    ("balance_sheet", "OtherNoncurrentFinancialAssets"),
    ("balance_sheet", "NoncurrentFinancialAssets"),
    ("balance_sheet", "DeferredTaxAssetsNet"),
    ("balance_sheet", "OtherNoncurrentAssets"),
    ("balance_sheet", "NoncurrentAssets"),
    ("balance_sheet", "CapitalWorkInProgress"),
    ("balance_sheet", "InvestmentProperty"),
    ("balance_sheet", "Goodwill"),
    ("balance_sheet", "OtherIntangibleAssets"),
    ("balance_sheet", "Assets"),
    ("balance_sheet", "AssetsCurrent"),
    ("balance_sheet", "Inventories"),
    ("balance_sheet", "TradeReceivablesCurrent"),
    ("balance_sheet", "TradePayables"),
    ("balance_sheet", "CashAndCashEquivalents"),
    ("balance_sheet", "CurrentLiabilities"),
    ("balance_sheet", "BankBalanceOtherThanCashAndCashEquivalents"),
    ("cash_flow", "CashFlowsFromUsedInOperations"),
    ("cash_flow", "CashFlowsFromUsedInOperatingActivities"),
    ("cash_flow", "CashFlowsFromUsedInInvestingActivities"),
    ("cash_flow", "CashFlowsFromUsedInFinancingActivities"),
    ("cash_flow", "DividendPaid", "dividends_paid"),
    ("cash_flow", "PaymentsForPurchaseOfNoncurrentAssets"),
    ("cash_flow", "PurchaseOfPropertyPlantAndEquipmentClassifiedAsInvestingActivities", CAPEX),
    ("cash_flow", "PurchaseOfOtherLongTermAssetsClassifiedAsInvestingActivities", CAPEX),
    ("cash_flow", "PurchaseOfInvestmentPropertyClassifiedAsInvestingActivities", CAPEX),
    ("cash_flow", "PurchaseOfIntangibleAssetsClassifiedAsInvestingActivities", CAPEX),
    ("cash_flow", "PurchaseOfIntangibleAssetsUnderDevelopment", CAPEX),
    ("per_share", "BasicEarningsLossPerShareFromContinuingOperations"),
    ("per_share", "DilutedEarningsLossPerShareFromContinuingOperations"),
    ("per_share", "BasicEarningsLossPerShareFromDiscontinuedOperations"),
    ("per_share", "DilutedEarningsLossPerShareFromDiscontinuedOperations"),
    ("per_share", "BasicEarningsLossPerShareFromContinuingAndDiscontinuedOperations"),
    ("per_share", "DilutedEarningsLossPerShareFromContinuingAndDiscontinuedOperations"),
]

# Statement a tag category is stored in.
CATEGORY_STATEMENT = {
    "income_statement": "income", "per_share": "income",
    "balance_sheet": "balance", "cash_flow": "cashflow",
}

# Concept lists per statement column, tried in order.
INCOME_CONCEPTS = {
    REVENUE: ["us-gaap_RevenueFromContractWithCustomerExcludingAssessedTax", "us-gaap_SalesRevenueNet", "us-gaap_Revenues"],
    PBT: [
        "us-gaap_IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest",
        "us-gaap_IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments",
    ],
    "tax_expense": ["us-gaap_IncomeTaxExpenseBenefit"],
    PAT: ["us-gaap_ProfitLoss", "us-gaap_NetIncomeLoss"],
    "profit_or_loss_attributable_to_owners_of_parent": ["us-gaap_NetIncomeLoss"],
    "comprehensive_income_for_the_period": ["us-gaap_ComprehensiveIncomeNetOfTax", "us-gaap_NetIncomeLoss"],
    FINANCE: [
        "us-gaap_InterestExpense", "us-gaap_InterestExpenseNonoperating", "us-gaap_InterestExpenseDebt",
        "us-gaap_InterestIncomeExpenseNet", "us-gaap_InterestIncomeExpenseOperatingNet",
    ],
    DEPRECIATION: [
        "us-gaap_DepreciationDepletionAndAmortization", "us-gaap_DepreciationAmortizationAndAccretionNet",
        "us-gaap_DepreciationDepletionAndAmortizationExcludingFinancingCosts",
    ],
    "expenses": ["us-gaap_CostsAndExpenses", "us-gaap_OperatingExpenses"],
    "operating_income": ["us-gaap_OperatingIncomeLoss"],
    "weighted_average_shares_basic": ["us-gaap_WeightedAverageNumberOfSharesOutstandingBasic"],
    "weighted_average_shares_diluted": ["us-gaap_WeightedAverageNumberOfDilutedSharesOutstanding"],
    "cost_of_revenue": ["us-gaap_CostOfRevenue", "us-gaap_CostOfGoodsAndServicesSold", "us-gaap_CostOfGoodsSold"],
    "current_tax": ["us-gaap_CurrentIncomeTaxExpenseBenefit"],
    "deferred_tax": ["us-gaap_DeferredIncomeTaxExpenseBenefit"],
    EPS_BASIC: ["us-gaap_EarningsPerShareBasic"],
    EPS_DILUTED: ["us-gaap_EarningsPerShareDiluted"],
}
BALANCE_CONCEPTS = {
    "assets": ["us-gaap_Assets"],
    "assets_current": ["us-gaap_AssetsCurrent"],
    "inventories": ["us-gaap_InventoryNet", "us-gaap_InventoryGross"],
    "trade_receivables_current": [
        "us-gaap_AccountsReceivableNetCurrent", "us-gaap_ReceivablesNetCurrent",
        "us-gaap_AccountsNotesAndLoansReceivableNetCurrent",
    ],
    "trade_payables": ["us-gaap_AccountsPayableCurrent", "us-gaap_AccountsPayableTradeCurrent"],
    "noncurrent_assets": ["us-gaap_AssetsNoncurrent"],
    "current_liabilities": ["us-gaap_LiabilitiesCurrent"],
    "noncurrent_liabilities": ["us-gaap_LiabilitiesNoncurrent"],
    "borrowings_current": ["us-gaap_DebtCurrent", "us-gaap_LongTermDebtCurrent"],
    "borrowings_noncurrent": ["us-gaap_LongTermDebtNoncurrent"],
    CASH: ["us-gaap_CashAndCashEquivalentsAtCarryingValue"],
    "goodwill": ["us-gaap_Goodwill"],
    "other_intangible_assets": [
        "us-gaap_FiniteLivedIntangibleAssetsNet", "us-gaap_IntangibleAssetsNetExcludingGoodwill",
        "us-gaap_IntangibleAssetsNetTotal", "us-gaap_IntangibleAssetsNet",
    ],
    "deferred_tax_assets_net": ["us-gaap_DeferredTaxAssetsNet"],
    "equity_share_capital": ["us-gaap_CommonStockValue", "us-gaap_CommonStocksIncludingAdditionalPaidInCapital"],
    "stockholders_equity": ["us-gaap_StockholdersEquity"],
    "total_equity_including_nci": [
        "us-gaap_StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest",
    ],
    "reserve_excluding_revaluation_reserves": ["us-gaap_RetainedEarningsAccumulatedDeficit"],
}
CASHFLOW_CONCEPTS = {
    OCF: [
        "us-gaap_NetCashProvidedByUsedInOperatingActivities",
        "us-gaap_NetCashProvidedByUsedInOperatingActivitiesContinuingOperations",
        "us-gaap_NetCashProvidedByUsedInOperatingActivitiesExcludingDividendsPaidNetOfDiscontinuedOperations",
    ],
    "dividends_paid": [
        "us-gaap_PaymentsOfDividends", "us-gaap_PaymentsOfDividendsCommonStock",
        "us-gaap_PaymentsOfDividendsPreferredStockAndPreferenceStock",
    ],
    CAPEX: [
        "us-gaap_PaymentsToAcquirePropertyPlantAndEquipment", "us-gaap_PaymentsToAcquireProductiveAssets",
        "us-gaap_PaymentsToAcquireOtherPropertyPlantAndEquipment",
    ],
}
# Concepts added up into depreciation when no direct tag exists.
DEPRECIATION_PARTS = [
    "us-gaap_Depreciation", "us-gaap_AmortizationOfIntangibleAssets", "us-gaap_AmortizationOfDeferredCharges",
]
# Longest distance between two quarter ends of one fiscal year.
MAX_QUARTER_GAP_DAYS = 125
# Oldest balance sheet that still fills a missing stock column.
CARRY_FORWARD_DAYS = 380
