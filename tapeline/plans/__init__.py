"""Registered queries; importing this package registers all of them."""

from tapeline.plans import calls, checkups, filings, fundamentals, loads, market, price, report, shapes, streams, words  # noqa: F401
