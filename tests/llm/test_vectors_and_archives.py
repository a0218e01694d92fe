"""Vector search, archives and chat logs against brute force and exact round trips."""

import gzip
import hashlib
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from polycell.llm import chat, topk, vectors, warc
from polycell.llm.common import shared_dir

VEC = "vec_id long, embedding array<float>, label int"


def clusters(seed=0):
    rng = np.random.default_rng(seed)
    rows = [x for x in rng.standard_normal((200, 24))]
    for _ in range(6):
        c = rng.standard_normal(24)
        rows += [c + 0.1 * np.linalg.norm(c) / 24**0.5 * rng.standard_normal(24) for _ in range(rng.integers(2, 40))]
    rows += [rows[3], rows[3], 2 * rows[5]]
    return np.array(rows).astype(np.float32)


def brute(x, cosine=0.95):
    x = x.astype(float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= cosine
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        new = np.minimum(label, np.where(near, label[None, :], len(x)).min(axis=1))
        if (new == label).all():
            break
        label = new
    return near.sum(axis=1), label


def test_near_duplicates_equal_brute_force(spark):
    x = clusters()
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    got = vectors.near_duplicates(spark, spark.createDataFrame(rows, VEC).repartition(5).withColumn("cid", F.lit(1))).toPandas().sort_values("vec_id")
    links, label = brute(x)
    assert got.n_links.sum() >= 0.98 * links.sum() and (got.n_links.to_numpy() <= links).all()
    assert (got.component_id.to_numpy() == label).mean() > 0.98
    assert (got.kept == (got.vec_id == got.component_id)).all()


def test_recall_over_small_windows(spark):
    x = clusters(3)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = vectors.near_duplicates(spark, spark.createDataFrame(rows, VEC), window=8).toPandas()
    assert got.n_links.sum() >= 0.9 * brute(x)[0].sum()


def test_recall_within_a_dense_group(spark):
    """A third of the vectors have cosine 0.9 to each other, and keys hardly tell them apart; pairs at the threshold are planted among them."""
    rng = np.random.default_rng(5)
    d, n = 48, 6000
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x = unit(rng.standard_normal((n, d)))
    centre = x[0]
    apart = unit(rng.standard_normal((n // 3, d)) - np.outer(rng.standard_normal(n // 3), centre))
    dense = unit(0.9**0.5 * centre + 0.1**0.5 * unit(apart - np.outer(apart @ centre, centre)))
    step = unit(rng.standard_normal((200, d)))
    pairs = unit(dense[:200] + 0.32 * unit(step - (step * dense[:200]).sum(1, keepdims=True) * dense[:200]))
    x = np.concatenate([x[: n - n // 3], dense, pairs])
    got = vectors.near_duplicates(spark, spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4), window=16).toPandas().sort_values("vec_id")
    links, _ = brute(x)
    assert links[-200:].sum() >= 150
    assert got.n_links.sum() >= 0.95 * links.sum() and (got.n_links.to_numpy() <= links).all()


def test_vectors_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (3, None, 0), (4, [0.0, 0.0], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [None, 1.0], 0), (8, [], 0), (9, [1.0, 0.0, 0.0], 0), (2, [1.0, 0.01], 0), (None, [0.0, 1.0], 0)]
    got = {(r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_duplicates(spark, spark.createDataFrame(rows, VEC)).collect()}
    assert got == {(1, 2, 1), (2, 2, 1), (None, 0, None), *((i, 0, i) for i in range(3, 10))}
    assert vectors.near_duplicates(spark, spark.createDataFrame([], VEC)).count() == 0


@pytest.mark.parametrize("scale,k", [(1024, 10), (3, 4)])
def test_top_k_equals_brute_force(spark, scale, k):
    rng = np.random.default_rng(scale)
    x = rng.standard_normal((700, 12)) / 3
    x[50:60] = x[40]
    rows = [(int(i), v.tolist(), 0) for i, v in enumerate(x)] + [(700, None, 0), (701, [float("nan")] * 12, 0), (800, [1.0, 2.0], 0)]
    all_ = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4), "vec_id", "embedding", scale)
    got = topk.top_k(spark, all_, all_.filter("vec_id % 100 = 0"), k).toPandas()
    q = np.floor(scale * x).astype(int)
    for i in range(0, 700, 100):
        score = q @ q[i]
        want = sorted(((-score[j], j) for j in range(700) if j != i))[:k]
        mine = got[got.query_id == i].sort_values("rank")
        assert list(zip(-mine.score, mine.vec_id, strict=True)) == want and mine["rank"].tolist() == list(range(1, k + 1))
    assert set(got.query_id) == set(range(0, 700, 100))


def test_bit_sliced_sums_are_exact():
    rng = np.random.default_rng(1)
    x = rng.integers(-900, 900, (130, 7))
    index = topk.SlicedIndex(x)
    for q in (rng.integers(-900, 900, 7), np.zeros(7, int), np.eye(7, dtype=int)[2]):
        bits = [np.unpackbits(s.view(np.uint8), bitorder="little")[:130] for s in index.add(q)]
        low = sum(min(int(v) * int(a), int(v) * int(b)) for v, a, b in zip(q, index.low, index.high, strict=True))
        assert (sum((b.astype(int) << i for i, b in enumerate(bits)), np.zeros(130, int)) + low == x @ q).all()


def test_top_k_of_few_rows_ties_and_none(spark):
    rows = spark.createDataFrame([(i, [1.0], 0) for i in (0, 5, 3, 9, 9)], VEC)
    all_ = topk.quantised(rows, "vec_id", "embedding", 8)
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in topk.top_k(spark, all_, all_.filter("vec_id = 0"), 10).orderBy("rank").collect()]
    assert got == [(0, 1, 3), (0, 2, 5), (0, 3, 9), (0, 4, 9)]
    assert topk.top_k(spark, all_.limit(0), all_.limit(0), 3).count() == 0


def test_top_k_of_repeated_rows_small_blocks_and_huge_components(spark):
    rng = np.random.default_rng(9)
    x = rng.integers(-50, 50, (90, 5)).astype(float)
    rows = [(int(i % 70), v.tolist()) for i, v in enumerate(x)] + [(7, [1.0] * 5)] * 40
    all_ = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), "vec_id", "embedding", 1).persist()
    got = topk.top_k(spark, all_, all_.filter("vec_id in (0, 7)"), 9, block_rows=16).toPandas()
    flat = [(i, np.array(v)) for i, v in rows]
    queries = {(i, tuple(v)) for i, v in flat if i in (0, 7)}
    want = sorted((i, r + 1, j, -s) for i, q in queries for r, (s, j) in enumerate(sorted((-int(np.dot(v, q)), j) for j, v in flat if j != i)[:9]))
    assert sorted(map(tuple, got[["query_id", "rank", "vec_id", "score"]].to_numpy().tolist())) == want
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        topk.quantised(huge, "vec_id", "embedding", 1024).count()


# -- archives --


def pages(spark):
    big, other = "é" * 700, "<p>" + "x" * 1500
    rows = [(1, "http://a", big), (2, "http://b\r\nx: y", big), (9, "http://c", big), (3, None, other), (4, "u", ""), (5, "u", None), (6, "u", "x" * 999), (7, "u", "x" * 999), (8, "u", "a\r\n\r\nWARC/1.1\r\n\r\n" * 90), (9, "again", big), (None, "n", other)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))


def test_archives_round_trip(spark):
    rows, df = pages(spark)
    path = f"{shared_dir(spark)}/warc-a"
    warc.write_warc(warc.deduplicated_records(df.repartition(3)), path)
    got = warc.read_warc(spark, path, "bytes").toPandas()
    assert len(got) == len(rows)
    by_digest = {}
    for r in got.itertuples():
        if r.record_type == "response":
            assert hashlib.sha1(r.payload).hexdigest() == r.payload_digest == r.payload_sha1
            by_digest[r.payload_digest] = r.payload
    want = sorted((str(i), hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in rows)
    assert sorted((r.record_id.removeprefix("urn:page:").replace("null", "None"), r.payload_digest) for r in got.itertuples()) == want
    types = {r.record_id: (r.record_type, r.refers_to) for r in got.itertuples()}
    assert types["urn:page:1"] == types["urn:page:2"] == ("revisit", "urn:page:9") and types["urn:page:9"][0] == "response"
    assert types["urn:page:6"][0] == types["urn:page:7"][0] == "response" and types["urn:page:null"] == ("revisit", "urn:page:3")
    assert got[got.record_id == "urn:page:2"].target_uri.iloc[0] == "http://b\r\nx: y"
    assert (got[got.record_type == "revisit"].http_length == got[got.record_type == "revisit"].payload_digest.map(lambda d: len(by_digest[d]))).all()


def test_predicates_are_pushed_and_payloads_left(spark):
    _, df = pages(spark)
    path = f"{shared_dir(spark)}/warc-b"
    warc.write_warc(warc.deduplicated_records(df), path)
    r = warc.read_warc(spark, path).filter("record_type = 'revisit' and record_id in ('urn:page:1', 'urn:page:3')")
    assert [x["record_id"] for x in r.collect()] == ["urn:page:1"]
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("http_length",), 3)])) == [GreaterThan(("http_length",), 3)]
    touched = []
    data = b"".join(warc.member(warc.record_bytes(dict(record_id=str(i), record_type="response", target_uri=None, warc_date=None, payload=bytes([i]) * 90_000, payload_digest=None, payload_length=None, refers_to=None))) for i in range(5))

    class Counted(io.BytesIO):
        def read(self, n=-1):
            touched.append(n)
            return super().read(n)

    kept = [h["warc-record-id"] for h, _ in warc.records(Counted(data), 0, len(data), lambda h: h["warc-record-id"] == "<3>", True)]
    assert kept == ["<3>"] and touched == [4096] * 5


def test_foreign_archives():
    rows = [warc.record_bytes(dict(record_id=str(i), record_type="response", target_uri="u", warc_date=None, payload=b"p" * i * 3000, payload_digest=None, payload_length=None, refers_to=None)) for i in range(4)]
    plain, packed = b"".join(rows), b"".join(map(gzip.compress, rows))
    # A member of all records, of two, of halves of one, and members of ours before foreign ones.
    whole, pairs = gzip.compress(plain), gzip.compress(rows[0] + rows[1]) + gzip.compress(rows[2] + rows[3])
    halves = b"".join(gzip.compress(plain[i : i + 700]) for i in range(0, len(plain), 700))
    mixed = warc.member(rows[0]) + gzip.compress(rows[1] + rows[2]) + warc.member(rows[3]) + b"\0" * 512
    for data, gz in ((plain, False), (packed, True), (whole, True), (pairs, True), (halves, True), (mixed, True)):
        found = [len(block().partition(b"\r\n\r\n")[2]) for _, block in warc.records(io.BytesIO(data), 0, len(data), lambda h: True, gz)]
        assert found == [0, 3000, 6000, 9000]
        one = [len(block(limit=100)) for _, block in warc.records(io.BytesIO(data), 0, len(data), lambda h: h["warc-record-id"] in ("<1>", "<3>"), gz)]
        assert one == [100, 100]
    for cut in (whole[:-200], packed[:-30]):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(cut), 0, len(cut), lambda h: True, True))


def test_archives_are_split_and_failed_files_left_out(spark):
    df = spark.createDataFrame([(i, "u", str(i) * 3000) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    path = f"{shared_dir(spark)}/warc-c"
    spark.dataSource.register(warc.WarcSource)
    warc.deduplicated_records(df).select(warc.WRITTEN).write.format("warc").mode("overwrite").option("splitBytes", 600).option("fileBytes", 3000).option("path", path).save()
    reader = warc.WarcReader({"path": path})
    assert len(reader.partitions()) > 5
    with open(path.removeprefix("file:") .replace("///", "/") + "/part-lost.warc.gz", "wb") as f:
        f.write(b"half a record")
    assert warc.read_warc(spark, path).count() == 60
    empty = f"{shared_dir(spark)}/warc-d"
    warc.write_warc(warc.deduplicated_records(df.limit(0)), empty)
    assert warc.read_warc(spark, empty).count() == 0


# -- chat --


def test_events_are_folded(spark):
    e = [(1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", ""), (1, 2, 1, "delta", None, "a"), (1, 3, 1, "delta", None, "b"), (1, 4, 1, "edit", None, "c"), (1, 5, 1, "delta", None, "d"), (1, 6, 2, "message", "user", "more"), (1, 7, 1, "regenerate", None, ""), (1, 8, 1, "delta", None, "new"), (1, 9, 2, "message", "user", "then"), (2, 1, 0, None, None, None)]
    log = spark.createDataFrame(e, "conv_id long, seq long, turn long, kind string, role string, text string").repartition(3)
    got = [tuple(r) for r in chat.fold_events(log).orderBy("conv_id", "turn").collect()]
    assert got == [(1, 0, "user", "hi"), (1, 1, "assistant", "new"), (1, 2, "user", "then"), (2, 0, "", "")]


def test_template_can_be_read_back(spark):
    rng = random.Random(3)
    parts = ["</turn>", "<turn", '">', "\\", "\\b", "\\l", "\n", "é", "\U0001f600", "</turn>\n", '<turn role="x">', "assistant", "### "]
    rows = [(c, t, rng.choice(["user", "assistant", 'odd"role', "sys\\tem"]), "".join(rng.choice(parts) for _ in range(rng.randrange(8)))) for c in range(25) for t in range(rng.randrange(1, 6))]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.parse(chat.render(m)).collect()
    assert len(out) == 25
    for r in out:
        own = sorted(x for x in rows if x[0] == r["conv_id"])
        assert [(x["role"], x["text"]) for x in r["turns"]] == [(x[2], x[3]) for x in own]
        assert r["loss_text"] == "".join(x[3] for x in own if x[2] == "assistant") and r["n_turns"] == len(own)


def test_chat_query_on_odd_rows(spark, tmp_path):
    rows = [(1, 0, "user", None), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, None, None, "y"), (None, 2, "assistant", "z" * 5000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(1)).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in chat.op4_chat_formatting(spark, str(tmp_path)).collect()}
    assert set(got) == {1, None, -7} and got[1]["n_turns"] == 4 and got[None]["loss_chars"] == 5000
    text = "\\### Assistant: </turn> ok"
    assert got[-7]["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert got[-7]["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
