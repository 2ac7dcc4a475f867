"""Byte-level BPE by recursive queries of an in-process DuckDB, one per partition.

* **Words.**  A pattern cuts a text into words, which are encoded separately.  A task
  encodes a word once and keeps the ids of the words it has met, and of what stands
  between spaces, up to ``KEPT`` of them.  A word that is a token is that token.
* **Encoding.**  All other words go to a recursive query as rows of word, position
  and token, one row a byte at first.  A step joins neighbours with the merge table
  and contracts in every word the leftmost pair of least rank, until no word has a
  pair left.  The same step also contracts what no other order could change: further
  places of that pair, and pairs of a rank below that of every merge that could ever
  take one of their two tokens from outside (``lefts``, ``rights``).  So a text of one
  long word takes few steps.  After ``STEPS`` of them, words that are not done are
  cut where no token can reach across (``bridges``), and a new recursion goes on.
* **Decoding.**  Rows of document, position and id join the vocabulary; an ordered
  aggregation puts the bytes of a document together.

Ids are kept packed, as little-endian unsigned 32-bit integers in a binary column.
The vocabulary is a file of lines ``base64 rank`` read on the driver; tables made from
it travel with the job and are bounded by its size (at most ``TOKENS`` tokens).

Defined cases: a null text is encoded like an empty one, as no ids; null ids decode to
no bytes.  All rows and columns stay; given columns of the names to be added are
replaced.  Ids that the vocabulary does not have raise an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

KEPT = 600_000  # parts of texts that a task remembers
KEPT_BYTES = 1 << 25  # and their bytes
LETTERS = 1 << 20  # bytes of words in one recursion; a longer word has one of its own
STEPS = 12
TEXT = 1 << 21  # bytes cut into words at a time
#: A space at the beginning or after white space of any kind, for two engines.
AFTER_SPACE = re.compile(r"^ |\s ")
SPACES = r"^ |[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
BREAK = re.compile(r"\S ")
DECODED = 1 << 20  # ids decoded at a time
TOKENS = 1 << 21
MEMORY = "320MB"  # of the query engine in a task; it spills beyond
BYTES = "latin-1"  # one character for each byte
ONE, CHAINED, LEFTMOST = 0, 1, 2  # how places of one pair in a word go together

CONTRACT = f"""
WITH RECURSIVE t AS (
  SELECT 0 AS step, word, pos, size, id FROM letters
  UNION ALL
  (WITH beside AS (
     SELECT word, pos, size, id, lead(word) OVER o = word AS joined, lead(id) OVER o AS next, lead(size) OVER o AS next_size,
       CASE WHEN lag(word) OVER o = word THEN lag(id) OVER o END AS before, CASE WHEN lead(word, 2) OVER o = word THEN lead(id, 2) OVER o END AS after
     FROM t WHERE step < {STEPS} WINDOW o AS (ORDER BY pos)),
   pairs AS (
     SELECT a.word, a.pos, a.size AS cut, a.size + a.next_size AS size, m.id, m.kind,
       m.kind = {ONE} AND (l.least IS NULL OR m.id < l.least) AND (r.least IS NULL OR m.id < r.least) AS certain
     FROM beside a JOIN merges m ON a.joined AND m.pair = (a.id::BIGINT << 32) + a.next
       LEFT JOIN lefts l ON l.pair = (a.before::BIGINT << 32) + a.id LEFT JOIN rights r ON r.pair = (a.next::BIGINT << 32) + a.after),
   least AS (SELECT word, min(id) AS id FROM pairs GROUP BY word),
   found AS (SELECT p.*, p.id = l.id AS best FROM pairs p JOIN least l ON p.word = l.word AND (p.id = l.id OR p.certain)),
   picked AS (
     SELECT word, pos, cut, size, id FROM found WHERE kind = {ONE}
     UNION ALL
     SELECT word, min(pos), arg_min(cut, pos), arg_min(size, pos), min(id) FROM found WHERE best AND kind = {LEFTMOST} GROUP BY word
     UNION ALL
     SELECT word, pos, cut, size, id FROM (
       SELECT *, row_number() OVER (PARTITION BY word, chain ORDER BY pos) AS place FROM (
         SELECT *, sum(fresh) OVER (PARTITION BY word ORDER BY pos) AS chain FROM (
           SELECT *, (lag(pos + cut) OVER (PARTITION BY word ORDER BY pos) IS DISTINCT FROM pos)::INT AS fresh
           FROM found WHERE best AND kind = {CHAINED}))) WHERE place % 2 = 1)
   SELECT t.step + 1, t.word, t.pos, coalesce(p.size, t.size), coalesce(p.id, t.id)
   FROM t SEMI JOIN least USING (word) LEFT JOIN picked p ON p.pos = t.pos ANTI JOIN picked q ON q.pos + q.cut = t.pos))
SELECT word, pos, size, id, step FROM t JOIN (SELECT word, max(step) AS step FROM t GROUP BY word) USING (word, step) ORDER BY pos
"""

DECODE = """
SELECT doc, array_to_string(list(letters ORDER BY pos), '') AS letters
FROM ids JOIN vocabulary USING (id) GROUP BY doc ORDER BY doc
"""


class Tables(NamedTuple):
    """What a vocabulary says, as arrays; see ``tables``."""

    ranks: dict[bytes, int]
    letters: np.ndarray
    merges: tuple[np.ndarray, np.ndarray, np.ndarray]
    lefts: tuple[np.ndarray, np.ndarray]
    rights: tuple[np.ndarray, np.ndarray]
    bridges: np.ndarray


def read_ranks(path: str) -> dict[bytes, int]:
    """Token -> rank from a file of lines ``base64 rank``; read on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _lowest(values: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(values, np.int64, len(values)), np.fromiter(values.values(), np.int64, len(values))


def tables(ranks: dict[bytes, int]) -> Tables:
    """The merge table and the bounds of a vocabulary.

    ``merges``: pair of tokens -> token, and how its places in a word go together:
    ``LEFTMOST`` if the token takes part in a merge of lower rank (then the next step
    may have a better pair), ``CHAINED`` if two places can share a token.
    ``lefts``: (token before, token) -> least rank of a merge of this token with one
    that ends like the token before it; ``rights`` likewise.  ``bridges``: neighbours
    that some merge may join, now or after both have grown.
    """
    if len(ranks) > TOKENS:
        raise ValueError(f"the vocabulary has more than {TOKENS} tokens")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"the vocabulary lacks the bytes {missing}")
    merges, lefts, rights, bridges = [], {}, {}, set()
    ends = {token: [ranks[token[i:]] for i in range(len(token)) if token[i:] in ranks] for token in ranks}
    starts = {token: [ranks[token[:i]] for i in range(1, len(token) + 1) if token[:i] in ranks] for token in ranks}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is None or right is None:
                continue
            merges.append((left, right, rank))
            for end in ends[token[:i]]:
                key = (end << 32) + right
                lefts[key] = min(rank, lefts.get(key, rank))
                bridges.update((end << 32) + start for start in starts[token[i:]])
            for start in starts[token[i:]]:
                key = (left << 32) + start
                rights[key] = min(rank, rights.get(key, rank))
    left, right, rank = np.array(merges, np.int64).reshape(-1, 3).T
    lower = np.union1d(left[left > rank], right[right > rank])
    shared = {(a, r) for a, r in zip(left.tolist(), rank.tolist())} & {(b, r) for b, r in zip(right.tolist(), rank.tolist())}
    kind = np.where(np.isin(rank, lower), LEFTMOST, np.where(np.isin(rank, [r for _, r in shared]), CHAINED, ONE))
    return Tables(ranks, np.array([ranks[bytes([b])] for b in range(256)], np.int64), ((left << 32) + right, rank, kind.astype(np.int8)),
                  _lowest(lefts), _lowest(rights), np.sort(np.fromiter(bridges, np.int64, len(bridges))))


def _rows(word: np.ndarray, pos: np.ndarray, size: np.ndarray, ids: np.ndarray) -> pa.Table:
    """Rows of the recursion; places leave a gap between words, so that only tokens of one word are neighbours."""
    return pa.table({name: values.astype(np.int32) for name, values in (("word", word), ("pos", pos + word), ("size", size), ("id", ids))})


def units(text: str) -> list[str]:
    """A text cut before every space that follows another character than white space.

    No word goes on over such a place, as words hold white space at their beginning only.
    All parts but the first stand without the space they begin with.
    """
    parts = text.split(" ")
    if not AFTER_SPACE.search(text):
        return parts
    out, own = [], parts[:1]  # what belongs to the last part, to be joined by spaces
    for part in parts[1:]:
        if not own[-1] or own[-1][-1].isspace():
            own.append(part)
        else:
            out.append(" ".join(own))
            own = [part]
    return [*out, " ".join(own)]


def pieces(text: str) -> Iterator[str]:
    """A long text in pieces of about ``TEXT`` characters, cut at such places too."""
    at = 0
    while at < len(text):
        found = BREAK.search(text, at + TEXT)
        till = found.start() + 1 if found else len(text)
        yield text[at:till]
        at = till


class Codec:
    """Encoder and decoder of one task.

    ``pattern`` must give words that hold white space at their beginning only.
    """

    def __init__(self, known: Tables, pattern: str):
        import duckdb
        import regex

        self.known, self.pattern = known, regex.compile(pattern)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})
        self._load("merges", pair=known.merges[0], id=known.merges[1].astype(np.int32), kind=known.merges[2])
        self._load("lefts", pair=known.lefts[0], least=known.lefts[1].astype(np.int32))
        self._load("rights", pair=known.rights[0], least=known.rights[1].astype(np.int32))
        self._load("vocabulary", id=pa.array(list(known.ranks.values()), pa.uint32()), letters=[t.decode(BYTES) for t in known.ranks])
        ids = np.fromiter(known.ranks.values(), np.int64)
        self.valid = np.zeros(ids.max() + 1, bool)
        self.valid[ids] = True
        self.packed: dict[str, bytes] = {}  # by word
        self.units: dict[str, bytes] = {}  # by what follows a space up to the next one
        self.held = 0

    def _load(self, name: str, **columns) -> None:
        self.con.register("given", pa.table(columns))
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def _tokens(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places (in the bytes of all words) and ids of the tokens, in order."""
        flat = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        rows = _rows(word, np.arange(len(flat)), np.ones(len(flat), np.int32), self.known.letters[flat])
        done = []
        while True:
            self.con.register("letters", rows)
            found = self.con.sql(CONTRACT).to_arrow_table()
            word, pos, size, ids, step = (found.column(c).to_numpy() for c in ("word", "pos", "size", "id", "step"))
            pos, open_ = pos - word, step >= STEPS
            done.append((pos[~open_], ids[~open_]))
            if not open_.any():
                pos, ids = (np.concatenate(parts) for parts in zip(*done))
                order = np.argsort(pos)
                return pos[order], ids[order]
            word, pos, size, ids = word[open_], pos[open_], size[open_], ids[open_]
            pair = (ids[:-1].astype(np.int64) << 32) + ids[1:]
            at = np.minimum(np.searchsorted(self.known.bridges, pair), len(self.known.bridges) - 1)
            cut = (word[1:] != word[:-1]) | (self.known.bridges[at] != pair)
            rows = _rows(np.r_[0, np.cumsum(cut)], pos, size, ids)

    def _encoded(self, words: list[str]) -> None:
        """Put the ids of words into ``packed``."""
        batch, letters = [], 0

        def flush() -> None:
            if batch:
                pos, ids = self._tokens([raw for _, raw in batch])
                starts = np.cumsum([0] + [len(raw) for _, raw in batch])
                bounds = (4 * np.searchsorted(pos, starts)).tolist()
                data = ids.astype("<u4").tobytes()
                for (word, _), a, b in zip(batch, bounds, bounds[1:]):
                    self.packed[word] = data[a:b]
                batch.clear()

        for word in words:
            raw = word.encode("utf-8", "surrogatepass")
            self.held += len(raw)
            if (rank := self.known.ranks.get(raw)) is not None:
                self.packed[word] = rank.to_bytes(4, "little")
                continue
            if letters + len(raw) > LETTERS:
                flush()
                letters = 0
            batch.append((word, raw))
            letters += len(raw)
        flush()

    def _look_up(self, heads: list[str], rest: set[str] | list[str]) -> dict[str, bytes]:
        """Packed ids of the first parts of texts; those of all others go to ``units``."""
        if len(self.units) > KEPT or self.held > KEPT_BYTES:
            self.packed, self.units, self.held = {}, {}, 0
        new = {u: self.pattern.findall(" " + u) for u in rest if u not in self.units}
        first = {u: self.pattern.findall(u) for u in set(heads)}
        self._encoded([w for w in {w for found in (new, first) for words in found.values() for w in words} if w not in self.packed])
        for unit, words in new.items():
            self.units[unit] = b"".join([self.packed[w] for w in words])
            self.held += len(unit)
        return {u: b"".join([self.packed[w] for w in words]) for u, words in first.items()}

    def _some(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts of any kind, or of pieces of them."""
        cut = [units(t) for t in texts]
        first = self._look_up([us[0] for us in cut], set().union(*(us[1:] for us in cut)))
        return [b"".join([first[us[0]], *map(self.units.__getitem__, us[1:])]) for us in cut]

    def _many(self, texts: pa.Array) -> list[bytes]:
        """Packed ids of texts without white space before spaces; every different part is looked up once."""
        parts = pc.split_pattern(texts, " ")
        coded = parts.values.dictionary_encode()
        which, names, edges = coded.indices.to_numpy().copy(), coded.dictionary.to_pylist(), parts.offsets.to_numpy()
        heads = [names[i] for i in which[edges[:-1]]]
        first = self._look_up(heads, names)
        ids = [*(self.units[u] for u in names), *(first[h] for h in heads)]
        which[edges[:-1]] = len(names) + np.arange(len(heads))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(sizes) - sizes
        n = sizes[which]
        ends = np.cumsum(n)
        out = np.frombuffer(b"".join(ids), "<u4")[np.repeat(starts[which] - (ends - n), n) + np.arange(n.sum())]
        bounds = np.r_[0, ends][edges].tolist()
        return [out[i:j].tobytes() for i, j in zip(bounds, bounds[1:])]

    def encode(self, texts: pa.Array | list[str | None]) -> Iterator[bytes]:
        """Packed ids of every text."""
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string()), "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(texts):
            till = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:at + 20_000]), TEXT, "right")))
            if sizes[at] > TEXT:
                yield b"".join(self._some([piece])[0] for piece in pieces(texts[at].as_py()))
            else:
                some = texts.slice(at, till - at)
                odd = pc.match_substring_regex(some, SPACES).to_numpy(zero_copy_only=False)
                found = [iter(of(some.filter(pa.array(odd == kind)))) if (odd == kind).any() else iter(()) for kind, of in ((False, self._many), (True, lambda x: self._some(x.to_pylist())))]
                yield from (next(found[int(o)]) for o in odd)
            at = till

    def _bytes(self, ids: list[np.ndarray]) -> list[bytes]:
        """Bytes of the ids of some documents."""
        sizes = [len(i) for i in ids]
        self.con.register("ids", pa.table({"doc": np.repeat(np.arange(len(ids)), sizes), "pos": np.arange(sum(sizes)), "id": np.concatenate([np.empty(0, "<u4"), *ids])}))
        out = [b""] * len(ids)
        found = self.con.sql(DECODE).to_arrow_table()
        for doc, letters in zip(found.column("doc").to_pylist(), found.column("letters").to_pylist()):
            out[doc] = letters.encode(BYTES)
        return out

    def decode(self, packed: list[bytes | None]) -> Iterator[bytes]:
        """Bytes of every list of packed ids."""
        every = [np.frombuffer(p or b"", "<u4") for p in packed]
        if any(ids.max() >= len(self.valid) or not self.valid[ids].all() for ids in every if len(ids)):
            raise ValueError("ids that the vocabulary does not have")
        at = 0
        while at < len(every):
            till, size = at, 0
            while till < len(every) and (till == at or size + len(every[till]) <= DECODED):
                size += len(every[till])
                till += 1
            if till == at + 1:
                yield b"".join(self._bytes([every[at][i:i + DECODED]])[0] for i in range(0, len(every[at]), DECODED))
            else:
                yield from self._bytes(every[at:till])
            at = till


def _added(df: DataFrame, column: str, names: dict[str, str], known: Tables, pattern: str, values) -> DataFrame:
    """``df`` with columns that ``values(codec, list of the column)`` gives, one narrow pass."""
    kept = [c for c in df.columns if c not in names]
    schema = df.select(*kept).schema
    for name, kind in names.items():
        schema = schema.add(name, kind)
    kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(known, pattern)
        for batch in source:
            added = values(codec, batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *(pa.array(v, kinds[k]) for v, k in zip(added, names.values()))],
                                             names=[*kept, *names])

    return df.select(*kept, df[column].alias("__given")).mapInArrow(run, schema)


def encode(df: DataFrame, known: Tables, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All rows with the packed ids of ``text``."""
    return _added(df, text, {ids: "binary"}, known, pattern, lambda codec, texts: [list(codec.encode(texts))])


def decode(df: DataFrame, known: Tables, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All rows with the bytes of the packed ``ids``."""
    return _added(df, ids, {decoded: "binary"}, known, ".", lambda codec, packed: [list(codec.decode(packed.to_pylist()))])


def _digests(codec: Codec, texts: pa.Array) -> list[list]:
    out: list[list] = [[], [], []]
    for i in range(0, len(texts), 2000):
        packed = list(codec.encode(texts.slice(i, 2000)))
        out[0] += [len(p) // 4 for p in packed]
        out[1] += [hashlib.sha256(p).hexdigest() for p in packed]
        out[2] += [hashlib.sha256(d).hexdigest() for d in codec.decode(packed)]
    return out


def round_trip(df: DataFrame, known: Tables, pattern: str, text: str = "text") -> DataFrame:
    """All rows with ``n_tokens`` and the digests of packed ids and of the bytes decoded from them (``ids_sha256``, ``decoded_sha256``)."""
    return _added(df, text, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, known, pattern, _digests)

