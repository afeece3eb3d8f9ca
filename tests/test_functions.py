from lociflow.functions import text


def test_columns(spark):
    df = spark.createDataFrame([("abba", "Été"), ("", "x1"), ("ab", None), (None, "ſol")], "w string, u string")
    from pyspark.sql import functions as F

    rows = df.select(
        text.word_pattern(F.regexp_extract_all("w", F.lit("."), F.lit(0))).alias("p"), text.normalize_word("u").alias("n"), text.fixed_blocks(F.col("w"), 3).alias("b"),
        text.edit1_keys(F.col("w")).alias("k"), text.alpha_runs(F.col("u")).alias("r"),
    ).collect()
    assert [r.p for r in rows] == ["0.1.1.0", "", "0.1", None]
    assert [r.n for r in rows] == ["ete", None, None, "sol"]
    assert [r.b for r in rows] == [["abb", "a"], [], ["ab"], []]
    assert rows[0].k == ["abba", "bba", "aba", "abb"] and rows[1].k == [""]
    assert rows[0].r == ["Été"] and rows[1].r == ["x"]


def test_token_distance_and_masks(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(["a", "b", "c"], ["a", "c"]), ([], ["x"]), (None, ["x"]), (["ab"], ["a", "b"])], "a array<string>, b array<string>")
    rows = df.select(text.token_distance("a", "b").alias("d"), text.set_bits(text.mask_of(F.col("b"), ["a", "b", "c"])).alias("n")).collect()
    assert [r.d for r in rows] == [1, 1, None, 2] and [r.n for r in rows] == [2, 0, 0, 2]
