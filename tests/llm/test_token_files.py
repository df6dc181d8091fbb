import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sensorspark.llm import token_files as t
from sensorspark.llm.common import BATCH_ROWS, BATCHES, chunks, small_batches

SCHEMA = "doc_id long, text string, shard int, ids string"
ODD = ["a  b", "a   b", " a", "a ", "a  ", "a \n b", "\n\na", "b \n", "x\n\n", "\ny", "\n\n\nz \n q", "\t\ta", "a\t b\tc", "it's  we'll\t x", "a b c", "<|endoftext|> x", "ab <|endoftext|> cd", "ab  <|endoftext|><|endoftext|>", "é è\nñ", "x\n", "'s 's\n's"]
ODD += ["1 2 3,4 5!? ..", "", "\n", " ", "a b", "日本 語", "\x1c x", "é.$'s", "×.÷.a", "a.'s b.'t's", "abc123def", "x²y", "ⅣaⅤ bª.", "  \r\n b\r\nc", "ǅ.a ʰ.b", "á.b é", "a  b", None]


def library():
    return Tokenizer.from_file(t.vocabulary())


def encoded(encoder, texts, limit):
    out = []
    for _, data, offsets in chunks(pa.array(texts, pa.string()), limit):
        ids, n = encoder.encode(data, offsets)
        out += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    return out


def test_words_encode_as_whole_texts_do(spark, tiny, monkeypatch):
    texts = [r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()] + [x or "" for x in ODD]
    want = [[*e.ids, 0] for e in library().encode_batch(texts, add_special_tokens=False)]
    encoder = t.Encoder(t.vocabulary())
    assert encoder.by_words
    for limit in (1, 500, 200_000, 1 << 30):
        assert encoded(encoder, texts, limit) == want
    monkeypatch.setattr(t, "TABLE_BYTES", 300_000)  # begins anew again and again
    assert encoded(encoder, texts, 5_000) == want
    monkeypatch.setattr(t, "prefix_hashes", lambda data: np.zeros(len(data) + 1, np.uint64))  # every word has one hash
    assert encoded(t.Encoder(t.vocabulary()), ODD * 2, 300) == [[*library().encode(x or "", add_special_tokens=False).ids, 0] for x in ODD * 2]


def test_special_tokens_are_the_librarys():
    k = library()
    for text in ("ab <|endoftext|> cd", "x<|endoftext|>", "  <|endoftext|>  ", "<|endoftext|>"):
        want = k.encode(text, add_special_tokens=False).ids
        assert 50256 in want and encoded(t.Encoder(t.vocabulary()), [text], 100) == [[*want, 0]]


def test_other_vocabularies_encode_whole_texts(tmp_path):
    from tokenizers import normalizers, pre_tokenizers

    for change in ("normalizer", "pre_tokenizer", "truncation"):
        k = library()
        if change == "normalizer":
            k.normalizer = normalizers.Lowercase()
        elif change == "pre_tokenizer":
            k.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
        k.save(path := str(tmp_path / f"{change}.json"))
        texts = ["Ab Cd  EF.", "x\n\nY"]
        encoder = t.Encoder(path)
        assert encoder.by_words == (change == "truncation")
        assert encoded(encoder, texts, 100) == [[*k.encode(x, add_special_tokens=False).ids, 0] for x in texts]


def brute(docs):
    start, out, k = 0, [], library()
    for i, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, len(d[1] or ""), d[1] or "")):
        ids = np.array([*k.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark, tiny):
    df = spark.read.parquet(f"{tiny}/documents.parquet")
    got = [tuple(r) for r in t.round_trip(df).orderBy("start").collect()]
    assert got == brute([(r.doc_id, r.text) for r in df.collect()])


def test_edge_cases_and_files(spark, tmp_path):
    docs = [*[(i, x) for i, x in enumerate(ODD)], (3, "again"), (3, "again"), (None, "no id"), (900, "long " * 30_000)]
    df = spark.createDataFrame([(*d, 1, "i") for d in docs], SCHEMA)
    assert [tuple(r) for r in t.round_trip(df).orderBy("start").collect()] == brute(docs)
    assert t.round_trip(df.limit(0)).count() == 0
    path = f"file://{tmp_path}/x.orc"
    t.write(df, path)
    files = t.read(spark, path)
    assert files.where("doc_id = 900").select(F.size("ids")).first()[0] == files.where("doc_id = 900").first().n_tokens
    assert [r.doc_id for r in files.orderBy("shard", "seq").collect()] == [x[0] for x in brute(docs)]


def scanned(df) -> int:
    """Rows that the scan of df gave out, after stripes and row groups were skipped."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_lookups_skip_row_groups_and_ids_are_run_length_encoded(spark, tmp_path):
    path = f"file://{tmp_path}/x.orc"
    n = 40_000
    t.write(spark.range(n).selectExpr("id * 2 AS doc_id", "concat('word number ', id) AS text"), path)
    files = t.read(spark, path)
    assert files.count() == n and scanned(t.read(spark, path).select("doc_id")) == n
    one = t.lookup(spark, path, [2 * 777])
    assert [r.doc_id for r in one.collect()] == [1554] and 0 < scanned(one) <= 2000
    absent = t.lookup(spark, path, [2 * 777 + 1])  # within the statistics' range: the Bloom filter tells
    assert absent.count() == 0 and scanned(absent) == 0
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for f in tmp_path.glob("x.orc/*.orc"):
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f"file://{f}"), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        rows = reader.rows()
        for i in range(reader.getStripes().size()):
            kinds = [c.getKind().toString() for c in rows.readStripeFooter(reader.getStripes().get(i)).getColumnsList()]
            assert kinds[-1] == "DIRECT_V2" and kinds[3] == "DIRECT_V2"  # ids' elements and doc_id
        rows.close()


@pytest.mark.parametrize("ids", [[], [None]])
def test_lookup_of_nothing(spark, tmp_path, ids):
    path = f"file://{tmp_path}/x.orc"
    t.write(spark.createDataFrame([(1, "a")], "doc_id long, text string"), path)
    assert t.lookup(spark, path, ids).count() == 0


def test_texts_reach_workers_in_small_batches(spark, tmp_path, monkeypatch):
    def sizes(path):
        def run(batches):
            for b in batches:
                m = b.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([0] * m, pa.int32()), pa.array(range(m), pa.int64()), b.column(0), pa.array([m] * m, pa.int32()), pa.array([[0]] * m, pa.list_(pa.int32()))], names=["shard", "seq", "doc_id", "n_tokens", "ids"])

        return run

    before = spark.conf.get(BATCHES)
    monkeypatch.setattr(t, "_encode", sizes)
    t.write(spark.range(20_000).selectExpr("id AS doc_id", "'x' AS text"), path := f"file://{tmp_path}/x.orc")
    assert t.read(spark, path).agg(F.count("*"), F.max("n_tokens")).first() == (20_000, BATCH_ROWS)
    assert spark.conf.get(BATCHES) == before


def test_small_batches_leave_the_session_as_it_was(spark):
    own = spark.conf.get(BATCHES)
    try:
        for before, meanwhile in (("10000", str(BATCH_ROWS)), ("7", "7"), ("0", str(BATCH_ROWS))):  # 0: no limit
            spark.conf.set(BATCHES, before)
            with pytest.raises(KeyError), small_batches(spark):
                assert spark.conf.get(BATCHES) == meanwhile
                raise KeyError
            assert spark.conf.get(BATCHES) == before
    finally:
        spark.conf.set(BATCHES, own)
