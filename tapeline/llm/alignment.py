"""Alignment of two tokenizers over the same texts.

Both tokenizers cut a text's bytes into tokens. Each list gets a dictionary from the byte offset
where a token ends to the token's index; offsets that both dictionaries have, in order, slice both
id lists into groups, the smallest spans that both tokenizers agree to cut out. Inside a slice a
link joins every token of the one list with every token of the other whose byte ranges overlap.

Counts of linked id pairs cover the whole corpus: each task writes its pieces of the corpus with
their distinct pairs, Spark sums the pairs, and every piece asks for its own pairs' counts by a
join, so neither links nor counts pass through the driver or are broadcast.

A text is cut at blanks that follow another character than white space: no token of either
vocabulary spans such a place (``byte_fallback`` checks the piece vocabulary), so a blank and what
follows it, a word here, has the same tokens, groups and links wherever it stands. The distinct
words of a piece are encoded and aligned once and the documents put together from them; what a
task holds is bounded by the piece and the longest run without blanks.

Edge cases: null and empty texts, and texts whose tokens' bytes are not a space and the text (a
lower one eighth block is read as a space), have no tokens; special-token strings in a text are
ordinary text; null ids and repeated rows are rows like any other and count each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm.common import map_texts, pieces
from tapeline.llm.decontamination import stored
from tapeline.llm.token_counts import PATTERN, load_vocabulary

BYTE_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a text that are encoded together, or up to the next place where a text can be cut.
PART_CHARS = 100_000
#: Text bytes of a piece of the corpus, whose distinct pairs are counted and looked up together (one document at least).
PIECE_BYTES = 8_000_000
#: Bits of an id in a pair's code.
ID_BITS = 32


@dataclass
class Tokenizers:
    """Encoders of both vocabularies and the bytes of their tokens."""

    encode_a: object
    encode_b: object
    bytes_a: list[bytes]
    bytes_b: list[bytes]

    def __post_init__(self) -> None:
        self.lengths_a = np.array([len(t) for t in self.bytes_a], dtype=np.int64)
        self.lengths_b = np.array([len(t) for t in self.bytes_b], dtype=np.int64)


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary: visible Latin-1 for itself, the others from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level(file: bytes) -> tuple[object, list[bytes]]:
    """Encoder and token bytes of a byte-level vocabulary in JSON.

    Tokens have to be numbered in the order of the merges that form them; the vocabulary is then
    the list of ranks that the encoder takes.
    """
    import tiktoken

    spec = json.loads(file)
    model, letters = spec["model"], byte_alphabet()
    special = {t["content"] for t in spec["added_tokens"]}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    if spec["normalizer"] is not None or any(model["vocab"][t] != 256 + i for i, t in enumerate(merged)):
        raise ValueError("tokens aren't numbered in the order of the merges, or texts are normalized")
    ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    table = [b""] * (1 + max(ranks.values()))
    for token, i in ranks.items():
        table[i] = token
    return tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, table


def byte_fallback(file: bytes) -> tuple[object, list[bytes]]:
    """Encoder and token bytes of a piece vocabulary with byte fallback; no piece may hold a space after another character."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=file)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any("▁" in n.lstrip("▁") for n in names):
        raise ValueError("a piece spans the place before a space")
    table = [bytes([int(n[1:-1], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
    return model.encode, table


def load(file_a: bytes, file_b: bytes) -> Tokenizers:
    (encode_a, bytes_a), (encode_b, bytes_b) = byte_level(file_a), byte_fallback(file_b)
    return Tokenizers(encode_a, encode_b, bytes_a, bytes_b)


def vocabularies(spark: SparkSession, a: str = BYTE_TOKENIZER, b: str = PIECE_TOKENIZER) -> tuple[Broadcast, Broadcast]:
    return load_vocabulary(spark, a), load_vocabulary(spark, b)


#: Where a text may be cut: a blank after another character than white space, not at the end.
CUT = re.compile(r"(?<=\S) (?=.)", re.DOTALL)


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """The text in parts of about ``size`` characters without the blanks it is cut at; the text is the parts with a blank between them."""
    start = 0
    while len(text) - start > size and (cut := CUT.search(text, start + size)):
        yield text[start : cut.start()]
        start = cut.end()
    yield text[start:]


@dataclass
class Alignment:
    """Ids of both tokenizers, the index after each group's last token in both lists, the linked tokens' indexes, and the byte offsets of the groups' ends."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    links_a: np.ndarray
    links_b: np.ndarray
    offsets: np.ndarray


def group_ends(offsets_a: np.ndarray, offsets_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes in both lists of the tokens that end where a token of the other list ends."""
    index_a = dict(zip(offsets_a.tolist(), range(len(offsets_a))))
    index_b = dict(zip(offsets_b.tolist(), range(len(offsets_b))))
    common = list(filter(index_a.__contains__, index_b))  # ascending, as the offsets were entered
    at_a = np.fromiter(map(index_a.__getitem__, common), np.int64, len(common))
    at_b = np.fromiter(map(index_b.__getitem__, common), np.int64, len(common))
    return at_a, at_b


def slice_links(offsets_a: np.ndarray, offsets_b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping tokens of all slices, as indexes in both lists.

    A slice of one token a list is one link. Else each end inside the slice closes the overlap
    of the two tokens that hold the byte before it; ends of both lists in order give the links.
    """
    sizes_a, sizes_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
    single = (sizes_a == 1) & (sizes_b == 1)
    in_a, in_b = np.repeat(~single, sizes_a), np.repeat(~single, sizes_b)
    more_a, more_b = np.nonzero(in_a)[0], np.nonzero(in_b)[0]
    order = np.argsort(np.concatenate([offsets_a[more_a], offsets_b[more_b]]), kind="stable")  # two sorted runs
    of_a = order < len(more_a)
    ends = np.where(of_a, offsets_a[more_a[np.where(of_a, order, 0)]] if len(more_a) else 0,
                    offsets_b[more_b[np.where(of_a, 0, order - len(more_a))]] if len(more_b) else 0)
    first = np.append(True, ends[1:] != ends[:-1]) if len(ends) else np.zeros(0, bool)
    # tokens of each list that ended before this place; of equal ends the one of list a stands first
    a, b = (np.cumsum(of_a) - of_a)[first], (np.cumsum(~of_a) - ~of_a)[first]
    return np.concatenate([at_a[single], more_a[a]]), np.concatenate([at_b[single], more_b[b]])


def align_part(part: str, t: Tokenizers) -> Alignment | None:
    """The alignment of a space and ``part``; none if a tokenizer's bytes differ from it."""
    ids_a, ids_b = t.encode_a(" " + part), t.encode_b(part)
    whole = (" " + part).encode()
    if b"".join(map(t.bytes_b.__getitem__, ids_b)) != whole:
        return None
    a, b = np.array(ids_a, dtype=np.int64), np.array(ids_b, dtype=np.int64)
    offsets_a, offsets_b = np.cumsum(t.lengths_a[a]), np.cumsum(t.lengths_b[b])
    if offsets_a[-1] != len(whole):  # merges of bytes keep the bytes, so their number decides
        return None
    at_a, at_b = group_ends(offsets_a, offsets_b)
    return Alignment(a, b, at_a + 1, at_b + 1, *slice_links(offsets_a, offsets_b, at_a, at_b), offsets_a[at_a])


def align(text: str | None, t: Tokenizers) -> Alignment | None:
    """The alignment of one text; none if it has no tokens."""
    if not text:
        return None
    found = [align_part(part, t) for part in parts(text)]
    if len(found) == 1 or any(f is None for f in found):
        return found[0] if len(found) == 1 else None
    fields = ("ids_a", "ids_b", "ends_a", "ends_b", "links_a", "links_b", "offsets")
    sizes = {"a": [len(f.ids_a) for f in found], "b": [len(f.ids_b) for f in found], "offsets": [f.offsets[-1] for f in found]}
    before = {k: np.cumsum([0, *v[:-1]]) for k, v in sizes.items()}
    shift = lambda c, k: 0 if c.startswith("ids") else before["offsets" if c == "offsets" else c[-1]][k]
    return Alignment(*[np.concatenate([getattr(f, c) + shift(c, k) for k, f in enumerate(found)]) for c in fields])


def written_groups(x: Alignment, names: list[bytes], width: int, other: int) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: ids by group, put together from ``group_names``."""
    na, nb = len(x.ids_a), len(x.ids_b)
    group_a = np.repeat(np.arange(len(x.ends_a)), np.diff(x.ends_a, prepend=0))
    group_b = np.repeat(np.arange(len(x.ends_b)), np.diff(x.ends_b, prepend=0))
    last_a, last_b = np.zeros(na, bool), np.zeros(nb, bool)
    last_a[x.ends_a - 1] = True
    last_b[x.ends_b - 1] = True
    starts_b = np.append(0, x.ends_b[:-1])
    out = np.empty(na + nb, np.int64)
    out[np.arange(na) + starts_b[group_a]] = x.ids_a + np.where(last_a, width, 0)
    out[np.arange(nb) + x.ends_a[group_b]] = x.ids_b + np.where(last_b, 2 * width + other, 2 * width)
    return b"".join(map(names.__getitem__, out.tolist()))[:-1]


def group_names(t: Tokenizers) -> tuple[list[bytes], int, int]:
    """Decimal ids of the first tokenizer with ',' and with '|', of the second with ',' and with ';', and both numbers of ids."""
    a, b = len(t.bytes_a), len(t.bytes_b)
    return [b"%d%b" % (i, mark) for size, mark in ((a, b","), (a, b"|"), (b, b","), (b, b";")) for i in range(size)], a, b


def _int_lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0), kind))


ALIGNED = ("doc_id long, tokens_a array<int>, tokens_b array<int>, group_ends_a array<int>, group_ends_b array<int>, "
           "links_a array<int>, links_b array<int>")


def alignments(docs: DataFrame, a: str = BYTE_TOKENIZER, b: str = PIECE_TOKENIZER) -> DataFrame:
    """Both token lists of every document, where each group ends in them, and the linked tokens by index; null without tokens."""
    files = vocabularies(docs.sparkSession, a, b)
    state: list[Tokenizers] = []

    def run(piece: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        if not state:
            state.append(load(files[0].value, files[1].value))
        found = [align(x.decode() if x else None, state[0]) for x in texts]
        columns = [pa.array([None if f is None else getattr(f, c).astype(np.int32) for f in found], pa.list_(pa.int32()))
                   for c in ("ids_a", "ids_b", "ends_a", "ends_b", "links_a", "links_b")]
        return pa.RecordBatch.from_arrays([piece.column(0), *columns], [c.split()[0] for c in ALIGNED.split(", ")])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ALIGNED, run)


@dataclass
class Words:
    """Alignments of distinct words: sizes, groups as text, and pair codes from ``starts[i]`` to ``starts[i + 1]``; a word that can't be aligned isn't ``known``."""

    known: np.ndarray
    sizes: np.ndarray  # tokens of a, tokens of b, groups, links
    written: list[bytes]
    codes: np.ndarray
    starts: np.ndarray


def align_words(words: list[str], t: Tokenizers, names: tuple[list[bytes], int, int]) -> Words:
    """Aligns words that a blank parts in some text, all of them as one text: no token and no link crosses a blank.

    A word with white space at its end is the last of its text, so it ends a run of words here too.
    """
    n = len(words)
    known, sizes, written, codes = np.zeros(n, bool), np.zeros((n, 4), np.int64), [b""] * n, []

    def run(first: int, last: int) -> None:
        own = words[first:last]
        x = align_part(" ".join(own), t)
        if x is None:
            if last - first == 1:
                codes.append(np.zeros(0, np.int64))
                return
            half = (first + last) // 2
            run(first, half)
            run(half, last)
            return
        ends = np.cumsum([len(w.encode()) + 1 for w in own])
        group = np.searchsorted(x.offsets, ends) + 1  # the end of a word is the end of a group
        order = np.argsort(x.links_a, kind="stable")
        a, b = x.links_a[order], x.links_b[order]
        codes.append(x.ids_a[a] << ID_BITS | x.ids_b[b])
        stops = np.stack([x.ends_a[group - 1], x.ends_b[group - 1], group, np.searchsorted(a, x.ends_a[group - 1])], axis=1)
        sizes[first:last] = np.diff(stops, axis=0, prepend=0)
        groups = written_groups(x, *names).split(b";")
        start = 0
        for i, stop in enumerate(group.tolist(), first):
            written[i] = b";".join(groups[start:stop])
            start = stop
        known[first:last] = True

    first = size = 0
    for i, w in enumerate(words):
        size += len(w) + 1
        if size >= PART_CHARS or w[-1].isspace() or i == n - 1:
            run(first, i + 1)
            first, size = i + 1, 0
    return Words(known, sizes, written, np.concatenate(codes) if codes else np.zeros(0, np.int64), np.append(0, np.cumsum(sizes[:, 3])))


class Documents:
    """Sums over the words of a piece's documents, taken in blocks of bounded size; a long document runs over several blocks."""

    def __init__(self, n: int, t: Tokenizers, names: tuple[list[bytes], int, int]):
        self.t, self.names = t, names
        self.known, self.sizes = np.ones(n, bool), np.zeros((n, 4), np.int64)
        self.hashes, self.pairs = [None] * n, [[] for _ in range(n)]

    def add(self, block: list[tuple[int, str]]) -> None:
        """Parts of documents in order; every distinct word of the block is aligned once."""
        number: dict[str, int] = {}
        held = [[number.setdefault(w, len(number)) for w in CUT.split(part)] for _, part in block]
        words = align_words(list(number), self.t, self.names)
        at = np.fromiter(chain.from_iterable(held), np.int64, sum(map(len, held)))
        starts = np.cumsum([0, *[len(h) for h in held[:-1]]])
        known, sizes = np.logical_and.reduceat(words.known[at], starts), np.add.reduceat(words.sizes[at], starts)
        distinct, pair_of = np.unique(words.codes, return_inverse=True)
        # the pairs of all words in order, each with its part of the block
        links = words.sizes[at, 3]
        ends = np.cumsum(links)
        pairs = pair_of[np.repeat(words.starts[at] - ends + links, links) + np.arange(ends[-1])]
        owner = np.repeat(np.arange(len(block)), sizes[:, 3])
        keys, counts = np.unique(owner * max(1, len(distinct)) + pairs, return_counts=True)
        owner, codes = keys // max(1, len(distinct)), distinct[keys % max(1, len(distinct))]
        bounds = np.searchsorted(owner, np.arange(len(block) + 1))
        for k, (doc, _) in enumerate(block):
            self.known[doc] &= known[k]
            self.sizes[doc] += sizes[k]
            text = b";".join(map(words.written.__getitem__, held[k]))
            if self.hashes[doc] is None:
                self.hashes[doc] = hashlib.sha256(text)
            else:
                self.hashes[doc].update(b";" + text)
            self.pairs[doc].append((codes[bounds[k] : bounds[k + 1]], counts[bounds[k] : bounds[k + 1]]))

    def results(self) -> Iterator[tuple[list[int], str, np.ndarray, np.ndarray]]:
        """For each document its sizes, digest, distinct pairs and their links."""
        none = np.zeros(0, np.int64)
        for known, sizes, digest, found in zip(self.known, self.sizes.tolist(), self.hashes, self.pairs):
            if not known or digest is None:
                yield [0, 0, 0, 0], "", none, none
                continue
            pairs, links = found[0]
            if len(found) > 1:
                pairs, at = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
                links = np.bincount(at, weights=np.concatenate([n for _, n in found])).astype(np.int64)
            yield sizes, digest.hexdigest(), pairs, links


PIECES = ("piece long, docs array<struct<doc_id:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string>>, "
          "pairs array<bigint>, pair_links array<bigint>, at array<array<int>>, links array<array<int>>")


def aligned_pieces(docs: DataFrame, a: str = BYTE_TOKENIZER, b: str = PIECE_TOKENIZER, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Pieces of the corpus: their documents' counts and digests, and linked pairs.

    ``pairs`` are the distinct codes (a's id << 32 | b's id) of the piece, ``pair_links`` their
    links in it. For each document ``at`` gives the places of its distinct pairs in ``pairs``,
    ``links`` its own links of them.
    """
    files = vocabularies(docs.sparkSession, a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(files[0].value, files[1].value)  # once a task
        names = group_names(t)
        docs_type = pa.struct([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string())])
        number = TaskContext.get().partitionId() << 32
        for piece, texts in pieces(batches, size=piece_bytes):
            found = Documents(len(texts), t, names)
            block, size = [], 0
            for i, text in enumerate(texts):
                for part in parts(text.decode(), piece_bytes) if text else ():
                    block.append((i, part))
                    size += len(part)
                    if size >= piece_bytes:
                        found.add(block)
                        block, size = [], 0
            if block:
                found.add(block)
            rows, codes, counts = [], [], []
            for doc_id, (sizes, digest, own, links) in zip(piece.column(0).to_pylist(), found.results()):
                rows.append(dict(zip([f.name for f in docs_type], [doc_id, *sizes, digest])))
                codes.append(own)
                counts.append(links)
            pairs, at = np.unique(np.concatenate(codes), return_inverse=True)
            held = np.bincount(at, weights=np.concatenate(counts), minlength=len(pairs)).astype(np.int64)
            ends = np.cumsum([len(c) for c in codes])[:-1]
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), one(pa.array(rows, docs_type)), one(pa.array(pairs, pa.int64())), one(pa.array(held, pa.int64())),
                 one(_int_lists(np.split(at, ends), pa.int32())), one(_int_lists(counts, pa.int32()))],
                ["piece", "docs", "pairs", "pair_links", "at", "links"])
            number += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Links of every linked id pair over the corpus, and whether no id of the first tokenizer has more links with its second id."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "pair_links")).alias("p"))
    counts = each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.pair_links").alias("count"))
    counts = counts.withColumn("id_b", F.col("pair").bitwiseAND(F.lit((1 << ID_BITS) - 1)))
    most = counts.groupBy("id_b").agg(F.max("count").alias("most"))
    return counts.join(most, "id_b").select("pair", F.shiftright("pair", ID_BITS).alias("id_a"), "id_b", "count", (F.col("count") == F.col("most")).alias("best"))


def cross_align(docs: DataFrame, a: str = BYTE_TOKENIZER, b: str = PIECE_TOKENIZER, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """For each document the size and digest of its alignment, its links whose pair is its second id's most linked, and the sum of its links' counts.

    The pieces are a table in the shared folder, read for the counts, for the requests and for the result.
    """
    aligned = stored(docs.sparkSession, aligned_pieces(docs, a, b, piece_bytes), "aligned")
    wanted = aligned.select("piece", F.posexplode("pairs").alias("place", "pair"))
    answers = wanted.join(pair_counts(aligned), "pair").groupBy("piece").agg(
        F.array_sort(F.collect_list(F.struct("place", "count", "best"))).alias("answers"))  # as many as the piece has pairs
    d = aligned.select("piece", "docs", "at", "links").join(answers, "piece", "left")
    zero = F.struct(F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))

    def add(acc, x):
        answer = F.get("answers", x["at"])
        return F.struct((acc["n_best"] + F.when(answer["best"], x["links"]).otherwise(0)).alias("n_best"),
                        (acc["count_sum"] + answer["count"] * x["links"]).alias("count_sum"))

    sums = F.transform(F.arrays_zip("at", "links"), lambda doc: F.aggregate(F.arrays_zip(doc["at"].alias("at"), doc["links"].alias("links")), zero, add))
    return d.select(F.explode(F.arrays_zip("docs", sums.alias("sums"))).alias("r")).select("r.docs.*", "r.sums.*")


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
