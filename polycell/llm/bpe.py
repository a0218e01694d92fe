"""Byte-level BPE by recursive DuckDB queries in each partition.

Texts are split by the vocabulary's pattern. A batch's pieces that aren't known
yet go to a table of token positions (word, position, token), one row per byte. A
recursive query joins neighbouring tokens with the merge table and contracts each
word's leftmost pair of minimum rank, until no word has a pair left. Pieces found
so are kept for the worker's later batches, up to a bound. Decoding joins ids with
the vocabulary and puts the pieces together by an ordered aggregation.

Three things keep the rounds few, also for a piece of millions of bytes, and
change no result:

* A word is cut where two bytes meet that stand side by side in no token, as no
  token can ever reach over such a place.
* Places of one longer word with the same pair of minimum rank are contracted in one
  round, from the left and without overlap, if no pair with the token that they
  give has a lower rank: then the leftmost of them would be next anyhow. Tokens
  for which that isn't so are contracted one place a round.
* Of a word of more than ``WINDOW`` bytes, overlapping windows are contracted, each
  as a word of its own, and put together at tokens that neighbouring windows have
  in common. Then any two tokens side by side stand so in a window too. The first
  contraction of the whole word that reached over one of their ends would only
  depend on the two tokens there, so it would have been done in that window; so
  there is none, and the whole word has the same tokens. If two windows have no
  token in common, the word is done again in windows of eight times the size.

Memory doesn't grow with a text: it is matched, encoded, hashed and decoded in
runs of pieces, and DuckDB spills what is beyond its limit to a folder of the
worker's own.
"""

from __future__ import annotations

import base64
import hashlib
import tempfile
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .textkernel import trim

#: Pieces that a worker remembers, and their ids.
REMEMBERED, REMEMBERED_IDS = 1_600_000, 16_000_000
#: Characters of texts, bytes of new pieces and ids that are handled at once; a longer piece stands alone.
RUN_CHARS, ROUND_BYTES, DECODED_IDS = 1 << 20, 400_000, 1 << 19
#: Bytes of a window: twice 3 * 64, so that runs of one sign of one to four bytes are cut alike in all windows.
WINDOW = 384
MEMORY = "300MB"

#: Bytes of words that are contracted one pair a round, which is cheaper where rounds are few.
SHORT = 32

#: Rows are (place, id): word and position in one number, word * 2**32 + position, so that one sorted column orders them.
_SINGLE = """
WITH RECURSIVE t(place, id, step) AS (
  SELECT place, id, 0 FROM start
  UNION ALL
  (WITH p AS MATERIALIZED (
    SELECT place, id, step, lag(place) OVER o AS before,
      CASE WHEN lead(place) OVER o >> 32 = place >> 32 THEN (id::BIGINT << 20) | lead(id) OVER o END AS pair
    FROM t WINDOW o AS (ORDER BY place)
  ), b AS (
    SELECT place >> 32 AS w, min((merges.id::BIGINT << 32) | (place & 4294967295)) AS best FROM p JOIN merges USING (pair) GROUP BY 1
  )
  SELECT place, CASE WHEN place & 4294967295 = best & 4294967295 THEN (best >> 32)::INTEGER ELSE id END, step + 1
  FROM p JOIN b ON place >> 32 = w
  WHERE before IS NULL OR before <> (w << 32 | (best & 4294967295)))
)
SELECT place, id FROM t JOIN (SELECT place >> 32 AS w, max(step) AS last FROM t GROUP BY 1) l ON place >> 32 = l.w AND step = last
ORDER BY place
"""

#: The same with all places of the word's best pair in a round, and with the latest row of each place only.
_STEP = """
WITH RECURSIVE t(place, id, step) USING KEY (place) AS (
  SELECT place, id, 0 FROM start
  UNION
  (WITH p AS MATERIALIZED (
    SELECT place, id, step, row_number() OVER o AS n,
      CASE WHEN lead(place) OVER o >> 32 = place >> 32 THEN (id::BIGINT << 20) | lead(id) OVER o END AS pair
    FROM t WINDOW o AS (ORDER BY place)
  ), m AS MATERIALIZED (
    SELECT place >> 32 AS w, (merges.id::BIGINT << 32) | (place & 4294967295) AS v, n, alone FROM p JOIN merges USING (pair)
  ), b AS MATERIALIZED (
    SELECT w, min(v) AS best FROM m GROUP BY w
  ), hit AS (
    SELECT n, (v >> 32)::INTEGER AS id, n - row_number() OVER (ORDER BY n) AS run
    FROM m JOIN b USING (w) WHERE v >> 32 = best >> 32 AND (v = best OR NOT alone)
  ), c AS MATERIALIZED (
    SELECT n, id FROM hit QUALIFY row_number() OVER (PARTITION BY run ORDER BY n) % 2 = 1
  )
  SELECT place, coalesce(c.id, p.id), step + 1
  FROM p SEMI JOIN b ON place >> 32 = w LEFT JOIN c USING (n) ANTI JOIN (SELECT n + 1 AS n FROM c) gone ON p.n = gone.n)
)
SELECT place, id FROM t JOIN (SELECT place >> 32 AS w, max(step) AS last FROM t GROUP BY 1) l ON place >> 32 = l.w AND step = last
ORDER BY place
"""

_DECODE = "SELECT doc, string_agg(piece, '' ORDER BY pos) AS text FROM ids JOIN vocabulary USING (id) GROUP BY doc"


class Encoder:
    """Encodes and decodes with the ranks of a tiktoken file, as one worker needs it."""

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED):
        import duckdb
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}
        if len(self.ranks) >= 1 << 20:
            raise ValueError("a vocabulary may have 2**20 tokens at most")
        self.remembered, self.pattern = remembered, regex.compile(pattern)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.inner = np.zeros((256, 256), bool)  # which two bytes stand side by side in a token
        for t in self.ranks:
            x = np.frombuffer(t, np.uint8)
            self.inner[x[:-1], x[1:]] = True
        self.spill = tempfile.TemporaryDirectory(prefix="bpe-", ignore_cleanup_errors=True)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": self.spill.name})
        parts = ((l << 20 | r, n) for t, n in self.ranks.items() for i in range(1, len(t)) if (l := self.ranks.get(t[:i])) is not None and (r := self.ranks.get(t[i:])) is not None)
        merges = np.fromiter(chain.from_iterable(parts), np.int64).reshape(-1, 2)
        lowest = np.full(1 << 20, 1 << 20)  # of the pairs that a token is in
        for end in (merges[:, 0] >> 20, merges[:, 0] & (1 << 20) - 1):
            np.minimum.at(lowest, end, merges[:, 1])
        self._create("merges", pa.table({"pair": pa.array(merges[:, 0]), "id": pa.array(merges[:, 1].astype(np.int32)), "alone": pa.array(lowest[merges[:, 1]] < merges[:, 1])}))
        self._create("vocabulary", pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "piece": pa.array([t.decode("latin-1") for t in self.ranks])}))
        self._forget()

    def close(self) -> None:
        self.db.close()
        self.spill.cleanup()

    def _create(self, name: str, data: pa.Table) -> None:
        self.db.register("given", data)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 20, np.int32), 0
        self.begin, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _remember(self, pieces: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        n = len(self.known)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(pieces) > len(self.begin):
            self.begin, self.size = np.concatenate([self.begin, np.zeros_like(self.begin)]), np.concatenate([self.size, np.zeros_like(self.size)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[n : n + len(pieces)] = sizes
        self.begin[n : n + len(pieces)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.known.update(zip(pieces, range(n, n + len(pieces)), strict=True))

    def learn(self, pieces: set[str]) -> None:
        names = list(pieces)
        raw = [p.encode("utf-8", "replace") for p in names]
        whole = np.fromiter((-1 if (r := self.ranks.get(b)) is None else r for b in raw), np.int64, len(raw))
        at = np.flatnonzero(whole >= 0)
        self._remember([names[i] for i in at], np.ones(len(at), np.int64), whole[at])
        part, size = [], 0
        for i in [*np.flatnonzero(whole < 0).tolist(), -1]:
            if part and (i < 0 or size + len(raw[i]) > ROUND_BYTES):
                self._remember([names[k] for k in part], *self._contracted([raw[k] for k in part]))
                part, size = [], 0
            if i >= 0:
                part.append(i)
                size += len(raw[i])

    def _contracted(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, ids of all pieces)."""
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        first = np.cumsum(sizes) - sizes
        cut = np.ones(len(data), bool)
        cut[1:] = ~self.inner[data[:-1], data[1:]]
        cut[first] = True
        starts = np.flatnonzero(cut)
        lengths = np.diff(starts, append=len(data))
        at, ids = self._recursion(data, starts, lengths, lengths <= WINDOW)
        for s, n in zip(starts[lengths > WINDOW], lengths[lengths > WINDOW], strict=True):
            more = self._long(data[s : s + n].tobytes(), WINDOW)
            at, ids = np.concatenate([at, more[0] + s]), np.concatenate([ids, more[1]])
        order = np.argsort(at, kind="stable")
        return np.diff(np.searchsorted(at[order], np.append(first, len(data)))), ids[order]

    def _recursion(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, id) of the tokens of wanted words, in order."""
        word = np.repeat(np.arange(len(starts)), lengths)
        own = self.byte_ids[data]
        one = starts[wanted & (lengths == 1)]  # a single byte is its own token
        at, ids = [one], [own[one]]
        place = (word << 32) + np.arange(len(data)) - starts[word]
        short = lengths <= SHORT
        for query, some in ((_SINGLE, wanted & short & (lengths > 1)), (_STEP, wanted & ~short)):
            some = some[word]
            if some.any():
                self.db.register("start", pa.table({"place": place[some], "id": own[some]}))
                got = self.db.execute(query).fetchnumpy()
                self.db.unregister("start")
                found = np.asarray(got["place"])
                at.append(starts[found >> 32] + (found & 0xFFFFFFFF))
                ids.append(np.asarray(got["id"]).astype(np.int32))
        at, ids = np.concatenate(at), np.concatenate(ids)
        order = np.argsort(at, kind="stable")
        return at[order], ids[order]

    def _long(self, data: bytes, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, id) of a long word's tokens."""
        step = window // 2
        begins = range(0, max(1, len(data) - step), step)
        texts = [data[a : a + window] for a in begins]
        distinct = list(dict.fromkeys(texts))
        tokens: dict[bytes, np.ndarray] = {}  # of each window, place * 2**20 + id
        per_round = max(1, ROUND_BYTES // window)
        for s in range(0, len(distinct), per_round):
            part = distinct[s : s + per_round]
            lengths = np.array([len(t) for t in part])
            starts = np.cumsum(lengths) - lengths
            at, ids = self._recursion(np.frombuffer(b"".join(part), np.uint8), starts, lengths, np.ones(len(part), bool))
            ends = np.searchsorted(at, np.append(starts, lengths.sum()))
            for t, a, b, z in zip(part, starts, ends[:-1], ends[1:], strict=True):
                tokens[t] = (at[b:z] - a) << 20 | ids[b:z]
        out, now, low = [], tokens[texts[0]], 0
        for a, t in zip(begins[1:], texts[1:], strict=True):
            after = tokens[t] + (a << 20)
            both = np.intersect1d(now, after, assume_unique=True)
            if not len(both):
                return self._long(data, 8 * window)
            seam = both[len(both) // 2]
            out.append(now[(now >= low) & (now < seam)])
            now, low = after, seam
        out.append(now[now >= low])
        got = np.concatenate(out)
        return got >> 20, (got & (1 << 20) - 1).astype(np.int32)

    def _pieces(self, text: str) -> Iterator[tuple[list[str], int]]:
        """(pieces, characters) of a text, in runs."""
        if len(text) <= RUN_CHARS:
            yield self.pattern.findall(text), len(text)
            return
        held, size = [], 0
        for m in self.pattern.finditer(text):
            held.append(m.group())
            size += len(held[-1])
            if size >= RUN_CHARS:
                yield held, size
                held, size = [], 0
        yield held, size

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Runs of (texts' places, number of ids of each, ids); a long text goes on over several runs."""
        run, size = [], 0
        for i, t in enumerate(texts):
            for pieces, chars in self._pieces(t):
                run.append((i, pieces))
                size += chars
                if size >= RUN_CHARS:
                    yield [i for i, _ in run], *self._ids([p for _, p in run])
                    run, size = [], 0
        if run:
            yield [i for i, _ in run], *self._ids([p for _, p in run])

    def _ids(self, found: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        pieces = list(chain.from_iterable(found))
        new = set(pieces).difference(self.known)
        if len(self.known) + len(new) > self.remembered or self.used > REMEMBERED_IDS:
            self._forget()
            new = set(pieces)
        if new:
            self.learn(new)
        at = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[at] - (ends - sizes), sizes)]
        sums = np.concatenate([[0], ends])
        return np.diff(sums[np.cumsum([0, *map(len, found)])]), ids

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Bytes of each run of ids: joined with the vocabulary, put together in order."""
        doc = np.repeat(np.arange(len(counts)), counts)
        out: list[list[bytes]] = [[] for _ in counts]
        for s in range(0, len(ids), DECODED_IDS):
            part = ids[s : s + DECODED_IDS]
            self.db.register("ids", pa.table({"doc": doc[s : s + DECODED_IDS].astype(np.int32), "pos": np.arange(len(part), dtype=np.int32), "id": part.astype(np.int32)}))
            got = self.db.execute(_DECODE).fetchall()
            self.db.unregister("ids")
            for d, t in got:
                out[d].append(t.encode("latin-1"))
        return [b"".join(x) for x in out]


_ENCODERS: dict = {}


def encoder(path: str, pattern: str, remembered: int = REMEMBERED) -> Encoder:
    """The worker's encoder, built once."""
    key = path, pattern, remembered
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(path, pattern, remembered=remembered)
    return _ENCODERS[key]


def release() -> None:
    """Drops the worker's encoder."""
    for enc in _ENCODERS.values():
        enc.close()
    _ENCODERS.clear()
    trim()


def _with_texts(df: DataFrame, text_col: str, schema: str, path: str, pattern: str, remembered: int, fn) -> DataFrame:
    """Runs fn(encoder, texts) -> columns over the texts of ``df``; other columns pass through."""
    df = df.drop(*[x.split()[0] for x in schema.split(", ") if x.split()[0] != text_col])  # ours take their place
    names = [c for c in df.columns if c != text_col]
    place = df.columns.index(text_col)

    def rows(batches):
        enc = encoder(path, pattern, remembered)
        for b in batches:
            texts = [t or "" for t in b.column(place).to_pylist()]
            rest = b.drop_columns([b.schema.names[place]])
            yield pa.RecordBatch.from_arrays([*rest.columns, *fn(enc, texts)], [*names, *[x.split()[0] for x in schema.split(", ")]])
        if remembered < REMEMBERED:
            del enc
            release()  # the worker's memory is wanted elsewhere

    kept = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != text_col)
    return df.mapInArrow(rows, f"{kept}, {schema}" if kept else schema)


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", remembered: int = REMEMBERED) -> DataFrame:
    """Puts the ids of every whole text, an array of int, in the place of the text; a null text has none."""

    def fn(enc, texts):
        n, parts = np.zeros(len(texts) + 1, np.int64), [np.zeros(0, np.int32)]
        for index, counts, ids in enc.encode(texts):
            np.add.at(n, np.array(index) + 1, counts)
            parts.append(ids)
        return [pa.ListArray.from_arrays(pa.array(np.cumsum(n), pa.int32()), pa.array(np.concatenate(parts), pa.int32()))]

    return _with_texts(df, text_col, f"{ids_col} array<int>", path, pattern, remembered, fn)


def round_trip(df: DataFrame, path: str, pattern: str, text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """Encodes every whole text and decodes its ids: n_tokens, ids_sha256, decoded_sha256 in the place of the text.

    ids_sha256 is over the ids as little-endian unsigned 32-bit integers,
    decoded_sha256 over the decoded bytes. Null and empty texts have no ids.
    Repeated rows give a row each; other columns pass through.
    """

    def fn(enc, texts):
        n, hashed, back = np.zeros(len(texts), np.int64), [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
        for index, counts, ids in enc.encode(texts):
            raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(counts) * 4
            for i, c, e, text in zip(index, counts.tolist(), ends.tolist(), enc.decode(ids, counts), strict=True):
                n[i] += c
                hashed[i].update(raw[e - 4 * c : e])
                back[i].update(text)
        return [pa.array(n), pa.array([h.hexdigest() for h in hashed], pa.string()), pa.array([h.hexdigest() for h in back], pa.string())]

    return _with_texts(df, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", path, pattern, remembered, fn)


def op8_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op8_byte_level_bpe": op8_byte_level_bpe}
SQL: dict[str, str] = {}
