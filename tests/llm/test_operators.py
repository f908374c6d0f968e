"""Operators of the training-data pipeline against brute force, on whole small tables and on odd ones."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import compare
from pyspark.sql import functions as F

from tapeline.llm import chat, decontamination, language_id, line_dedup, mixing, near_dup, quality_rules, sharding, token_counts, toxicity
from tapeline.llm.checks import CHAT_SQL, DECONTAMINATION_SQL, LINE_DEDUP_SQL
from tapeline.llm.common import lower_words, table
from tapeline.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, shard string, id string, text_key string, n int, doc int, line string, rate string, score string, p string, carried0 int"
PASSAGE = " ".join(f"passage{i}" for i in range(60))
FIRST = "the quick brown fox jumps over the lazy dog while nine wise owls watch from far away"


def extra(n):
    return (n, "s", "i", "k", n, n, "l", "r", "x", "p", n)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows and columns that clash with the operators' own."""
    texts = [
        (1, FIRST, "en", "a"), (2, FIRST, "en", "b"), (2, FIRST, "en", "b"), (2, FIRST + " tonight", "en", None), (None, FIRST, None, None), (None, None, None, None),
        (3, None, "en", "a"), (4, "", "en", "a"), (5, "   \n\t\n ", "de", "a"), (6, "12 34 5.6", "de", "a"), (7, PASSAGE + "\n" + PASSAGE, "fr", "c"),
        (8, "x\n" + PASSAGE + "\ny", "fr", "c"), (9, "\n".join(["a b c"] * 40), "es", "c"), (10, "\n".join(["a b c"] * 40), "es", "c"), (11, "wort " * 30_000, "de", "d"),
        (12, "Ünïcödé wörd\u2003x \U0001f600 " * 5, "de", "d"), (-13, "one", "en", "a"), (14, "[INST] <s> ### | &", "en", "a"), (15, "A" * 50_000, "en", "a"),
    ]
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), *extra(k)) for k, (i, t, lang, s) in enumerate(texts)], DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (None, 1, 1), (4, None, None), (7, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, FIRST), (2, "Lazy Dog"), (3, None), (4, ""), (None, "one"), (5, "Lazy, dog!"), (10, PASSAGE)], "item_id long, text string")


def rows(df):
    return sorted((tuple(str(v) for v in r) for r in df.collect()))


# --- the whole small tables ---


@pytest.mark.parametrize("name,sql", [("op1_line_dedup", LINE_DEDUP_SQL), ("op3_decontamination", DECONTAMINATION_SQL), ("op10_chat_format", CHAT_SQL)])
def test_matches_sql(name, sql, spark, duck, sf):
    ok, message = compare(QUERIES[name](spark, sf), duck, sql)
    assert ok, message


def simhash(text):
    import xxhash

    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, fps, radius=2):
    part = list(range(len(ids)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                part[root(i)] = root(j)
    low = defaultdict(list)
    for i in range(len(ids)):
        low[root(i)].append(ids[i])
    return [min((x for x in low[root(i)] if x is not None), default=None) for i in range(len(ids))]


def test_near_duplicates(spark, sf, odd):
    for docs in (table(spark, sf, "documents"), odd):
        got = docs.select("doc_id", "text").collect()
        fps = [simhash(r.text) for r in got]
        want = sorted((str(r.doc_id), f"{f:016x}", str(c)) for r, f, c in zip(got, fps, components([r.doc_id for r in got], fps)))
        assert rows(near_dup.near_duplicates(docs)) == want


def test_tiles_lose_no_link(spark):
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = {0, (1 << 64) - 1, 1, 3, 7} | set(centres)
    for c in centres:
        x = c
        for _ in range(60):
            x ^= 1 << rng.randrange(64)
            fps |= {x, x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)), rng.getrandbits(64)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    docs = spark.createDataFrame([(s,) for s in signed], "fp long")
    want = components(fps, fps)
    for segments, block in ((1, 50), (4, 7), (8, 4096)):
        found = near_dup.components(near_dup.links(docs, segments=segments, block=block)).collect()
        to = {r.node: r.root for r in found}
        group = defaultdict(set)
        for f, s in zip(fps, signed):
            group[to.get(s, s)].add(f)
        assert sorted(map(sorted, group.values())) == sorted(sorted(f for f, c in zip(fps, want) if c == w) for w in set(want))


def test_components_of_a_long_path(spark):
    path = list(range(60))
    random.Random(2).shuffle(path)
    edges = spark.createDataFrame([(a, b) for a, b in zip(path, path[1:])] + [(100, 101), (101, 101)], "a long, b long")
    found = {r.node: r.root for r in near_dup.components(edges).collect()}
    assert found == {**{i: 0 for i in range(1, 60)}, 101: 100}


def test_keep_first(odd):
    got = near_dup.keep_first(odd)
    assert got.columns == odd.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert len(kept) == len(set(kept)) and (None, FIRST) in kept and (1, FIRST) not in kept  # null ids come first
    groups = near_dup.near_duplicates(odd.select("text", F.xxhash64("doc_id", "text").alias("doc_id"))).select("component_id").distinct().count()
    assert len(kept) == groups


def decontaminated(docs, items, width=13):
    wins = defaultdict(set)
    for i, t in items:
        w = lower_words((t or "").encode())
        for k in range(max(1, len(w) - width + 1) if w else 0):
            wins[tuple(w[k : k + width])].add("null" if i is None else str(i))
    out = []
    for i, t in docs:
        w = lower_words((t or "").encode())
        hit, found = set(), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[tuple(w[k : k + n])]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((str(i), str(len(w)), str(len(hit)), str(len(found)), sha, str(bool(hit) and 20 * len(hit) >= len(w))))
    return sorted(out)


@pytest.mark.parametrize("block", [5, 200_000])
def test_decontamination_of_odd_rows(odd, benchmark, block):
    want = decontaminated([(r.doc_id, r.text) for r in odd.collect()], [(r.item_id, r.text) for r in benchmark.collect()])
    assert rows(decontamination.digest(decontamination.decontaminate(odd, benchmark, block_windows=block))) == want
    kept = decontamination.clean(odd, benchmark)
    assert kept.columns == odd.columns and kept.count() == sum(r[-1] == "False" for r in want)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha x beta y gamma z delta"), (3, "delta gamma beta alpha"), (4, "alpha beta")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "alpha beta gamma delta")], "item_id long, text string")
    got = {r.doc_id: (r.items, r.near_items) for r in decontamination.decontaminate(docs, items, slack=3).collect()}
    assert got == {1: (["7"], ["7"]), 2: ([], ["7"]), 3: ([], []), 4: ([], [])}


def test_empty_benchmark(odd, benchmark):
    d = decontamination.decontaminate(odd, benchmark.where("false")).collect()
    assert len(d) == odd.count() and not any(r.n_hit or r.contaminated for r in d)


def test_line_dedup_of_odd_rows(odd):
    got = {(r.doc_id, r.text): r for r in line_dedup.line_dedup(odd).collect()}
    assert got[7, PASSAGE + "\n" + PASSAGE].clean_text == PASSAGE
    assert got[8, "x\n" + PASSAGE + "\ny"].clean_text == "x\ny"
    assert got[9, "\n".join(["a b c"] * 40)].n_removed == 39 and got[10, "\n".join(["a b c"] * 40)].n_removed == 40
    assert got[3, None].clean_text is None and got[3, None].n_lines == 0
    assert got[1, FIRST].n_removed == 0  # short lines stay
    whole = line_dedup.delete_runs(odd, line_dedup.dedup_runs(odd))
    assert set(odd.columns) < set(whole.columns) and whole.count() == odd.count()


def test_line_runs_random(spark):
    rng = random.Random(5)
    docs = [(i, "\n".join(rng.choice(["a", "b b", "", "c c c"]) for _ in range(rng.randrange(60)))) for i in range(25)]
    seen, want = {}, {}
    for i, t in docs:
        lines = t.split("\n")
        gone = set()
        for k in range(len(lines)):
            total, e = 0, k
            while e < len(lines) and total < 8:
                total += len(lines[e].split())
                e += 1
            if total >= 8:
                if tuple(lines[k:e]) in seen:
                    gone |= set(range(k, e))
                seen.setdefault(tuple(lines[k:e]), (i, k))
        want[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.clean_text for r in line_dedup.line_dedup(frame, 8).collect()} == want
    runs = line_dedup.maximal_runs(line_dedup.dedup_runs(frame, 8)).collect()
    by_doc = {i: t.split("\n") for i, t in docs}
    assert runs and all(by_doc[r.doc][r.first_line : r.first_line + r.n_lines] == by_doc[r.kept.doc][r.kept.line : r.kept.line + r.n_lines] for r in runs)


def test_sharding(spark, sf, odd):
    for docs in (table(spark, sf, "documents"), odd):
        got = sharding.assign(docs, bucket_rows=7).collect()
        held = Counter(r.shard for r in got)
        assert len(got) == docs.count() and set(held) <= set(range(16)) and max(held.values()) - min([held.get(s, 0) for s in range(16)]) <= 1
        assert {(r.shard, r.slot) for r in got} == {(s, k) for s, n in held.items() for k in range(n)}
        for r in got:
            t = (r.text or "").encode()
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 1, zlib.crc32(t), "rows", None)
        curve = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
        assert curve == sorted(curve)
    cells = sharding.manifest(sharding.assign(odd)).collect()
    assert sum(r["rows"] for r in cells) == odd.count()


def test_hilbert_neighbours():
    points = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
    order = np.argsort(sharding.hilbert_numbers(points, 3))
    assert (np.abs(np.diff(points[order], axis=0)).sum(axis=1) == 1).all()


def test_token_counts(spark, sf, odd):
    docs = table(spark, sf, "documents")
    vocabulary = open(token_counts.TOKENIZER, "rb").read()
    encode = token_counts._encoder(vocabulary).encode_ordinary
    for d in (docs.limit(60), odd):
        texts = [r.text or "" for r in d.select("text").collect()]
        n = sorted(len(encode(t)) for t in texts)
        hist = token_counts.histogram(token_counts.encoded_lengths(d))
        got = {r.length: r for r in hist.collect()}
        assert sorted(got) == sorted(set(n))
        for length, r in got.items():
            assert r.truncated_total == sum(min(length, x) for x in n) and r.tokens_upto == sum(x for x in n if x <= length)
            assert r.docs_over == sum(x > length for x in n) and r.quantile == sum(x <= length for x in n) / len(n) and r.lost_tokens == sum(n) - r.truncated_total
        for limit in (0, 3, 100, 10**6):
            assert token_counts.truncated_total(hist, limit).first()[0] == sum(min(limit, x) for x in n)


def repeated(words):
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w, n in Counter(wins).items() if n > 1}
    return len({i + k for i, w in enumerate(wins) if w in twice for k in range(5)})


def test_quality_statistics(spark, sf, odd):
    import re

    for docs in (table(spark, sf, "documents"), odd):
        got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.statistics(docs).collect()}
        want = set()
        for r in docs.select("doc_id", "text").collect():
            t = r.text or ""
            words = re.findall(r"[^\x20\x09-\x0D]+", t)
            lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            want.add((r.doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeated(words)))
        assert got == want


def test_repeated_words_with_many_names():
    rng = random.Random(3)
    words = [f"w{rng.randrange(9000)}" for _ in range(30_000)]
    words[20_000:20_009] = words[100:109]
    assert quality_rules.repeated_words(words) == repeated(words) >= 18


def test_learned_list():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality_rules.FEATURES)))
    bad = (x[:, 2] > 0.8) | ((x[:, 3] > 0.7) & (x[:, 5] <= 0.4))
    rules = quality_rules.learn(x, bad, np.arange(len(x)) % 3 == 0)
    fired = np.zeros(len(x), bool)
    for r in rules:
        fired |= quality_rules._covers(r, x)
    assert rules and (fired & ~bad).mean() < 0.01 and (fired & bad).sum() > 0.9 * bad.sum()


def test_quality_query(spark, sf, odd, labels, nothing):
    docs, named = table(spark, sf, "documents"), table(spark, sf, "labels")
    rules = quality_rules.fit(docs, named)
    assert all(isinstance(x, str) for x in quality_rules.describe(rules))
    got = quality_rules.judge(docs, named).collect()
    assert len(got) == docs.count() and not any(r.kept and r.base_failed for r in got)
    few = {r.doc_id: r for r in quality_rules.judge(odd, labels).collect()}
    assert few[3].base_failed and not few[3].kept and few[1].kept and quality_rules.judge(nothing, labels).count() == 0
    assert quality_rules.judge(odd, labels.where("false")).where("kept").count() > 0


def test_chain_posteriors_match_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    chain = language_id.Chain(["x", "y", "z"], [frozenset()] * 3)
    chain.moves, chain.first = rng.normal(size=(3, 3)), rng.normal(size=3)
    potentials, ids, lengths = rng.random((4, 3)) + 0.1, np.array([0, 1, 2, 3, 3, 1]), np.array([4, 2])
    got = chain.posteriors(potentials, ids, lengths)
    for s, (a, b) in enumerate(((0, 4), (4, 6))):
        total = np.zeros(3)
        norm = 0.0
        for path in product(range(3), repeat=b - a):
            w = np.exp(chain.first[path[0]] + sum(chain.moves[i, j] for i, j in zip(path, path[1:])))
            w *= np.prod([potentials[ids[a + t], y] for t, y in enumerate(path)])
            norm += w
            total += w * np.bincount(path, minlength=3)
        assert np.allclose(got[s], total / norm)


def test_language(spark, odd, nothing):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got) > 0 and all(0 <= r.score <= 1 for r in got)
    few = {r.doc_id: r.lang_pred for r in language_id.identify(odd).collect()}
    assert few[3] == few[4] == few[5] == few[6] == "und" and few[1] != "und" and language_id.identify(nothing).count() == 0
    kept = language_id.accepted(odd, 0.0)
    assert kept.columns == odd.columns and kept.count() == sum(v != "und" for v in map(lambda r: r.lang_pred, language_id.identify(odd).collect()))
    unlearned = language_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unlearned} == {("und", 0.0)}


def test_words_have_languages(spark):
    chain = language_id.train(["a", "b"], [(0, [b"un", b"deux", b"trois", b"quatre"] * 20), (1, [b"one", b"two", b"three", b"four"] * 20)])
    words = [b"un", b"deux", b"trois", b"one", b"two", b"three", b"four"]
    p = chain.posteriors(chain.emissions(words), np.arange(7), np.array([7]), per_word=True)
    assert p.argmax(axis=1).tolist() == [0, 0, 0, 1, 1, 1, 1]


def test_whole_runs_have_positions():
    """Runs without blanks are read to their end, and cut where the script changes."""
    run = "".join(chr(0x4E00 + 7 * i) for i in range(50))
    tail = {language_id.zlib.crc32(run[-1].encode(), 4) % language_id.HASHED}
    words = language_id.words_of(run + "\u3002" + "\u3042\u3044" * 30)
    assert b"".join(w.strip(b"\x01")[language_id.OVERLAP * w.startswith(b"\x01"):] for w in words).decode() == run + "\u3042\u3044" * 30
    assert tail <= {f for w in words for f in language_id.features(w)}
    chain = language_id.train(["ja", "zh"], [(0, language_id.words_of("\u3042\u3044\u3046\u3048\u304a" * 30)), (1, language_id.words_of(run * 3))])
    mixed = language_id.words_of(run + "\u3042\u3044\u3046\u3048\u304a" * 10)
    p = chain.posteriors(chain.emissions(mixed), np.arange(len(mixed)), np.array([len(mixed)]), per_word=True)
    assert p[0].argmax() == 1 and p[-1].argmax() == 0
    word = "\u043f\u0440\u0435" * 12 + "\u043e\u0441\u0442\u044c"  # 40 letters, 80 bytes
    last = language_id.features(language_id.words_of(word)[-1])
    assert zlib.crc32(word.encode()[-3:] + b"$", 2) % language_id.HASHED in last and language_id.words_of("d\u00e9j\u00e0 vu") == ["d\u00e9j\u00e0".encode(), b"vu"]


def test_no_language_is_left_out(spark, monkeypatch):
    """All languages up to the bound are learned, and more are an error."""
    many = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26)} " * 5, f"l{i:03}") for i in range(400)]
    known = sorted({lang for i, _, lang in many if zlib.crc32(str(i).encode()) % language_id.FOLDS != language_id.HELD_OUT})
    d = spark.createDataFrame(many, "doc_id long, text string, lang string")
    sample = language_id.training_sample(d).collect()
    assert len(known) > 256 and {r.lang for r in sample} == set(known)
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", len(known) - 1)
    with pytest.raises(ValueError, match="languages"):
        language_id.training_sample(d)


def test_stretches_of_a_chain(monkeypatch):
    rng = np.random.default_rng(2)
    chain = language_id.Chain(["x", "y", "z"], [frozenset()] * 3)
    chain.moves, chain.first = rng.normal(size=(3, 3)), rng.normal(size=3)
    potentials, lengths = rng.random((9, 3)) + 0.1, np.array([23, 20, 20, 7, 6, 1])
    ids = rng.integers(0, 9, lengths.sum())
    whole, words = chain.posteriors(potentials, ids, lengths), chain.posteriors(potentials, ids, lengths, per_word=True)
    for size in (1, 2, 5, 20, 22, 23):
        monkeypatch.setattr(language_id, "STRETCH", size)
        assert np.array_equal(chain.posteriors(potentials, ids, lengths), whole) and np.array_equal(chain.posteriors(potentials, ids, lengths, per_word=True), words)


def test_a_text_of_a_million_words(spark):
    import resource

    d = spark.createDataFrame([(1, "un deux trois quatre " * 250_000 + "one", None), (2, "", None)], "doc_id long, text string, lang string").repartition(1)
    samples = [(0, [b"un", b"deux", b"trois", b"quatre"] * 20), (1, [b"one", b"two", b"three", b"four"] * 20)]
    chain = language_id.train(["a", "b"], samples)
    got = {r.doc_id: r for r in language_id.predict(d, chain).collect()}
    assert got[1].lang_pred == "a" and got[1].score > 0.9 and got[2].lang_pred == "und"
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    n = 400_000
    chain.posteriors(chain.emissions([b"un", b"one"]), np.arange(n) % 2, np.array([n]))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 40_000  # kilobytes; all steps would be 90 MB


def test_parts_end_at_blanks():
    text = "aa b \n ccc  d" * 50 + "e" * 90
    for size in (1, 5, 40, 10_000):
        parts = list(language_id.blank_parts(text, size))
        assert "".join(parts) == text and [w for x in parts for w in language_id.words_of(x)] == language_id.words_of(text)


def test_size_codes_cover_every_size(spark):
    d = spark.createDataFrame([(1 << b,) for b in range(31)] + [((1 << 31) - 1,)], "size long").withColumns({"lang": F.lit(None), "source": F.lit("s")})
    codes = [r.c for r in d.select(sharding.quantised()[2].alias("c")).collect()]
    assert codes == sorted(codes) and len(set(codes)) == 32 and codes[-1] == 61


def test_repeated_rows_are_spread(spark):
    docs = spark.createDataFrame([(7, "same", "en", "a")] * 3000 + [(8, None, None, None)], "doc_id long, text string, lang string, source string").repartition(4)
    d = sharding.assign(docs, bucket_rows=100)
    got = d.collect()
    held = Counter(r.shard for r in got)
    assert len({(r.shard, r.slot) for r in got}) == 3001 and max(held.values()) - min(held.values()) <= 1 and len(held) == 16


def test_nearest_is_exact():
    rng = np.random.default_rng(4)
    weights = {b"t%d" % i: (i, 1.0 + rng.random()) for i in range(40)}
    empty = toxicity.build_index([], weights)
    texts = [[b"t%d" % t for t in rng.integers(0, 40, rng.integers(0, 9))] for _ in range(500)]
    vectors = [(i, int(rng.random() < 0.3), empty.vector(t)) for i, t in enumerate(texts)]
    index = toxicity.build_index(vectors, weights)
    dense = np.zeros((500, 40))
    for row, i in enumerate(index.ids):
        for t, w in vectors[i][2].items():
            dense[row, t] = w
    every = [(slice(0, len(index.ids)), slice(0, len(index.starts)))]
    found = index.nearest([index.arrays(q) for q in texts[:60]], k=[25], parts=every)
    for q, (got,) in zip(texts, found):
        v, got = index.vector(q), list(zip(*got))
        s = dense @ np.array([v.get(t, 0.0) for t in range(40)])
        want = sorted(((round(float(x), 9), i) for i, x in enumerate(s) if round(float(x), 9) > 0), key=lambda x: (-x[0], x[1]))[:25]
        assert [i for _, i in got] == [i for _, i in want] and np.allclose([x for x, _ in got], [x for x, _ in want])


def test_votes_match_brute_force(monkeypatch):
    """Neighbours of each label, their votes and the scores, with and without the text's own example."""
    monkeypatch.setattr(toxicity, "NEAR", (100, 25))
    rng = np.random.default_rng(6)
    weights = {b"t%d" % i: (i, 1.0 + rng.random()) for i in range(3000)}
    empty = toxicity.build_index([], weights)
    texts = [[b"t%d" % min(2999, int(t)) for t in rng.exponential(400, 30)] for _ in range(900)]
    index = toxicity.build_index([(i, int(i % 4 == 0), empty.vector(t)) for i, t in enumerate(texts)], weights)
    index.slopes, index.shift, index.alone = (7.0, -3.0), -0.5, 0.125
    assert (index.row < 0).any() and (index.row >= 0).any() and len(index.starts) > 2 and index.neighbours() == [[6, 3], [27, 9]]
    by_id = {i: empty.vector(t) for i, t in enumerate(texts)}
    place = {i: int(np.nonzero(index.ids == i)[0][0]) for i in range(40)}
    for skip in (False, True):
        found = index.nearest([index.arrays(texts[q]) for q in range(40)], without=[place[q] if skip else -1 for q in range(40)])
        for q, got in enumerate(found):
            every = [(round(sum(x * by_id[i].get(t, 0.0) for t, x in by_id[q].items()), 9), at) for at, i in enumerate(index.ids.tolist()) if not skip or i != q]
            means = {}
            for y, k, few in ((0, 27, 6), (1, 9, 3)):
                want = sorted((x for x in every if x[0] > 0 and index.toxic[x[1]] == y), key=lambda x: (-x[0], x[1]))[:k]
                assert got[y][1].tolist() == [i for _, i in want] and np.allclose(got[y][0], [x for x, _ in want])
                means[y] = np.array([sum(x for x, _ in want[:few]) / few, sum(x for x, _ in want) / k])
            votes = means[1] - means[0]
            assert index.votes(got) == pytest.approx(votes.tolist())
            assert index.score(got) == pytest.approx(1 / (1 + np.exp(-(7 * votes[0] - 3 * votes[1] - 0.5))))
    assert index.score(index.nearest([index.arrays([])])[0]) == 0.125


def test_curve_is_the_weighted_optimum():
    rng = np.random.default_rng(8)
    x, w = rng.normal(size=(900, 2)) * (0.02, 3.0), rng.random(900) + 0.2
    y = (rng.random(900) < 1 / (1 + np.exp(-(120 * x[:, 0] - 0.4 * x[:, 1] - 1)))).astype(float)
    slopes, shift = toxicity.logistic(x, y, w)
    p = 1 / (1 + np.exp(-(x @ slopes + shift)))
    assert abs((w * (y - p)).sum()) < 1e-6 * w.sum() and (abs(x.T @ (w * (y - p))) < 5e-3 * w.sum() * np.array([0.02, 3.0])).all()
    assert 80 < slopes[0] < 170 and -0.7 < slopes[1] < -0.2


def test_toxicity(spark, odd, labels, nothing):
    docs, named = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    some = docs.join(named.select("doc_id"), "doc_id", "left_semi")
    got = toxicity.toxicity(some, named).join(named, "doc_id").where("held_out").collect()
    tp = sum(r.predicted and r.toxic for r in got)
    assert tp >= 0.75 * sum(r.toxic for r in got) and sum(r.predicted and not r.toxic for r in got) <= 0.01 * len(got)
    for d, n in ((odd, labels), (odd, labels.where("false")), (nothing, labels)):
        got = toxicity.toxicity(d, n).collect()
        assert len(got) == d.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_toxicity_reads_every_word(spark):
    """An exact copy of an example finds it, whatever its words, and evidence is the cosine over all words of the examples."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(12)) for _ in range(60)]
    texts = [t + " foul" * (i < 12) for i, t in enumerate(texts)]
    texts[13] = "lonely words that nobody else has"
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(texts)] + [(2000, texts[20] + " unseen unseen new")], "doc_id long, text string")
    named = spark.createDataFrame([(i, 1, int(i < 14)) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, named).collect()}
    inside = [i for i in range(60) if zlib.crc32(str(i).encode()) % toxicity.FOLDS != toxicity.HELD_OUT]
    assert 13 in inside and 20 in inside
    for i in inside:
        best = got[1000 + i].evidence[0]
        assert best.doc_id == i and best.similarity == pytest.approx(1)
    words = [t.split() for t in [*texts, *texts, texts[20] + " unseen unseen new"]]
    df = Counter(w for t in words for w in set(t))
    inside_df = Counter(w for i in inside for w in set(words[i]))
    smaller = min(sum(i < 14 for i in inside), sum(i >= 14 for i in inside))
    weight = {w: np.log((1 + len(words)) / (1 + n)) ** 2 * min(1, inside_df[w] * toxicity.COMMON / smaller) for w, n in df.items()}
    v = {w: (1 + np.log(n)) * weight[w] for w, n in Counter(words[-1]).items()}
    u = {w: (1 + np.log(n)) * weight[w] for w, n in Counter(words[20]).items()}
    cosine = sum(x * v[w] for w, x in u.items()) / np.sqrt(sum(x * x for x in u.values()) * sum(x * x for x in v.values()))
    best = got[2000].evidence[0]
    assert best.doc_id == 20 and best.similarity == pytest.approx(cosine)


def test_mixing_meets_targets(spark, odd, labels, nothing):
    docs, named = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    domains = mixing.label_domains(named)
    d, fit = mixing.mix(docs, domains)
    names = sorted(mixing.TARGETS)
    got = mixing.digest(d, names).toPandas()
    total = got.n_tokens.sum()
    units = mixing.UNITS
    assert (got.rate >= 0).all() and (got[[f"units_{n}" for n in names]].sum(axis=1) == units).all()
    # the targets hold for the posteriors as they were before they became units, the smallest one too
    model = mixing.fit_classifier(docs, domains, names)
    rate = dict(zip(got.doc_id, got.rate))
    reached = np.zeros(len(names))
    for r in docs.select("doc_id", "text").collect():
        n, features = mixing.text_features(r.text.encode() if r.text is not None else None)
        reached += n * rate[r.doc_id] * model.posterior(model.logits(features))
    for n, x in zip(names, reached / total):
        assert x == pytest.approx(mixing.TARGETS[n], rel=0.01)
    again = mixing.digest(mixing.mix(docs.repartition(7), domains)[0], names).toPandas()
    assert (again.sort_values("doc_id").rate.to_numpy() == got.sort_values("doc_id").rate.to_numpy()).all()
    known = got.merge(domains.toPandas(), on="doc_id")
    best = known[[f"units_{n}" for n in names]].to_numpy().argmax(axis=1)
    assert (np.array(names)[best] == known.domain).mean() > 0.9
    sample = mixing.resample(docs, domains)
    assert sample.columns == docs.columns
    words = sample.select(F.sum(F.size(F.split("text", r"\s+")))).first()[0]
    assert abs(words / total - 1) < 0.15
    for x, y in ((odd, labels), (odd, labels.where("false")), (nothing, labels)):
        d, _ = mixing.mix(x, mixing.label_domains(y))
        assert d.count() == x.count() and mixing.resample(x, mixing.label_domains(y)).columns == x.columns


def test_empty_tables(nothing):
    assert line_dedup.digest(line_dedup.line_dedup(nothing)).count() == 0
    assert token_counts.histogram(token_counts.encoded_lengths(nothing)).count() == 0
    assert near_dup.near_duplicates(nothing).count() == 0 and sharding.assign(nothing).count() == 0


# --- chat layouts ---


def turns_of(spark, *payloads):
    d = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, payload string")
    d = chat.read_back(chat.format_turns(chat.canonical(d))).orderBy("i").collect()
    assert all([tuple(t) for t in r.turns] == [tuple(t) for t in r.turns_read] for r in d)
    assert all(r.loss_read == [t.text for t in r.turns if t.role == "assistant"] for r in d)
    return [(r.layout, [tuple(t) for t in r.turns]) for r in d]


def test_layouts(spark):
    got = turns_of(
        spark, '{"prompt":"a <s>","response":"b\\\\n</s>"}', '{"response":"b","prompt":null}', '{"instruction":"do","input":"","output":"x"}', '{"instruction":"do","input":"it","output":"x"}',
        '{"messages":[{"role":"user","content":"[INST]"},{"role":"assistant","content":"\\\\<|im_end|>\\n"}]}', '{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g"},{"from":"x\\ny","value":""}]}',
        "not json", None, '{"other":1}', '{"prompt":"a","completion":"b"}')
    assert got == [
        ("prompt", [("user", "a <s>"), ("assistant", "b\\n</s>")]), ("prompt", [("user", ""), ("assistant", "b")]), ("instruction_input", [("user", "do"), ("assistant", "x")]),
        ("instruction_input", [("user", "do\nit"), ("assistant", "x")]), ("messages", [("user", "[INST]"), ("assistant", "\\<|im_end|>\n")]),
        ("shared", [("user", "h"), ("assistant", "g"), ("x\ny", "")]), (None, []), (None, []), (None, []), ("completion", [("user", "a"), ("assistant", "b")])]


def test_fingerprint_is_of_paths(spark):
    d = spark.createDataFrame([('{"a":1,"b":[{"c":"x"}]}',), ('{"b":[{"c":2.5},{"c":null}],"a":"y"}',), ('{"a":1,"b":[{"d":"x"}]}',)], "payload string")
    a, b, c = [r.f for r in d.select(chat.fingerprint("payload").alias("f")).collect()]
    assert a == b != c


def test_conversations_of_odd_rows(spark):
    rows_ = [(1, 0, "user", None, 5), (1, 1, "assistant", "</s>", 5), (1, 1, "assistant", "</s>", 5), (2, None, None, "x", 5), (None, 0, "tool", "\\", 5), (None, 1, "assistant", "ok\\", 5), (4, 0, "human", "h", 5), (4, 1, "assistant", "", 5)]
    d = spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string, payload int")
    got = {r.conv_id: r for r in chat.format_conversations(d).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 3, 2: 1, None: 2, 4: 2}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\n</s>\nassistant\n</s>\n").hexdigest() and got[1].loss_chars == 8
    assert got[None].loss_sha256 == hashlib.sha256(b"ok\\").hexdigest() and got[4].turns_sha256 == hashlib.sha256(b"human\nh\nassistant\n\n").hexdigest()
    assert chat.format_conversations(d.where("false")).count() == 0


def test_texts_beyond_the_limits_of_parsers(spark):
    long = spark.range(1).select(F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.repeat(F.lit("a"), 25_000_000).alias("text"))
    d = long.union(long.select(F.lit(1), F.lit(1), F.lit("assistant"), F.lit("ok")))
    d = d.union(long.select(F.lit(2), F.lit(0), F.lit("tool"), "text"))
    got = {r.conv_id: r for r in chat.format_conversations(d).collect()}
    assert (got[1].n_turns, got[1].layout, got[2].n_turns, got[2].layout) == (2, "prompt", 1, "messages")
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n" + b"a" * 25_000_000 + b"\nassistant\nok\n").hexdigest()
    payload = F.to_json(F.struct(F.col("text").alias("prompt"), F.lit("ok").alias("response")))
    with pytest.raises(Exception, match="does not parse"):
        chat.canonical(long.select(payload.alias("payload"))).select("layout").collect()


# --- pipeline ---


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = table(spark, sf, "documents")
    cols = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        new = stage(spark, docs, sf)
        assert new.columns == cols or name == "sharding", name
        path = corpus_pipeline.new_run_dir(spark, "test")
        new.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.count() > 0, name
        if name == "near_dedup":
            assert near_dup.near_duplicates(docs).groupBy("component_id").count().where("count > 1").count() == 0
        if name == "decontamination":
            assert not any(r.contaminated for r in decontamination.decontaminate(docs, table(spark, sf, "benchmark")).collect())
    assert docs.groupBy("shard").count().count() == 16
    assert rows(corpus_pipeline.run(spark, sf).select("doc_id", "shard", "slot")) == rows(docs.select("doc_id", "shard", "slot"))


def test_stages_of_empty_and_odd_tables(spark, sf, odd, nothing):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf).count() == 0
        got = stage(spark, odd, sf)
        assert name == "sharding" or got.columns == odd.columns
        assert got.count() > 0
