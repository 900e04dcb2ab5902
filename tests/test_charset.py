from pyspark.sql import functions as F

from wordloom.functions.charset import CLASS, MASK, SAMPLE_RANGES, SEPARATOR, SPECIAL, UNKNOWN, CharTable, tokenize

SMALL, FULL = CharTable(), CharTable().with_ranges(SAMPLE_RANGES)


def test_layout():
    assert FULL.bases == (5, 197, 277, 533, 1301, 1436, 1692, 1804, 1929, 2220, 2314, 2409, 2505, 2761)
    assert (SMALL.single_base, FULL.single_base, FULL.size) == (2185, 2806, 2841)
    assert FULL.collisions() == set(range(2806, 2841))
    assert not SMALL.collisions()
    assert CharTable.from_json(FULL.to_json()) == FULL


def test_encode_and_decode(spark):
    words = ["abc", "", "é😀م", "x" * 17, "y" * 30, "漢", "a\nb", SPECIAL[4]]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    rows = df.select("i", FULL.encode_word(F.col("w")).alias("ids")).withColumn("mask", FULL.attention(F.col("ids"))).withColumn("back", FULL.decode_word(F.col("ids"), F.least(F.lit(17), F.lit(3)))).orderBy("i").collect()
    assert all(len(r.ids) == 20 for r in rows)
    assert rows[0].ids[:6] == [CLASS, 2220 + 64, 2220 + 65, 2220 + 66, SEPARATOR, 0]
    assert rows[1].ids[:3] == [CLASS, SEPARATOR, 0]
    assert rows[2].back == "é😀م"
    assert rows[3].ids[18] == SEPARATOR
    assert rows[4].ids == [CLASS, *[2220 + 88] * 17, SEPARATOR, 0]
    assert rows[5].ids[1] == UNKNOWN
    assert rows[6].ids[2] == FULL.single_base + 1
    assert rows[7].ids[1] == MASK
    assert rows[0].mask == [1] * 5 + [0] * 15


def test_without_marks(spark):
    df = spark.createDataFrame([("x" * 30,)], "w string")
    w = F.col("w")
    r = df.select(FULL.encode_word(w, False, True).alias("a"), FULL.encode_word(w, True, False).alias("b"), FULL.encode_word(w, False, False).alias("c")).first()
    assert r.a[19] == SEPARATOR
    assert r.a[:19] == [2220 + 87] * 19
    assert r.b == [CLASS, *[2220 + 87] * 18, 0]
    assert r.c == [2220 + 87] * 20


def test_masking(spark):
    df = spark.range(4000).select("id", F.array_repeat(F.lit(100), 20).alias("ids"))
    m = df.select("id", FULL.mask_ids(F.col("ids"), F.col("id"), 0.2).alias("m"))
    again = df.repartition(5).select("id", FULL.mask_ids(F.col("ids"), F.col("id"), 0.2).alias("m"))
    assert sorted(map(str, m.collect())) == sorted(map(str, again.collect()))
    cells = m.select(F.explode(F.arrays_zip("m.ids", "m.labels")).alias("c")).select("c.*").groupBy().agg(F.sum((F.col("labels") != -100).cast("int")), F.sum((F.col("ids") == MASK).cast("int")), F.count(F.lit(1))).first()
    assert abs(cells[0] / cells[2] - 0.2) < 0.01
    assert abs(cells[1] / cells[0] - 0.8) < 0.02


def test_tokenize(spark):
    df = spark.createDataFrame([("ab c",), ("abc",)], "t string")
    assert [r.x for r in df.select(tokenize(F.col("t")).alias("x")).collect()] == [["ab", "c"], ["a", "b", "c"]]
