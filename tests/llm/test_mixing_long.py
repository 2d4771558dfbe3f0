from chunkloom.llm import mixing as mx


def test_a_source_with_a_third_of_its_words_in_one_document(spark):
    for long in range(4):  # its hash, and so where the last pass meets it, differs
        rows = [(i, " ".join(["w"] * 10), s) for s in "ab" for i in range(200 * (s == "b"), 200 + 400 * (s == "b"))]
        rows += [(1000 + long, " ".join(["w"] * 2000), "b")]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        got = mx.draws(df, weights=(1, 1), shards=4).collect()
        for s in "ab":
            taken = sum(r.mix.copies * r.mix.size for r in got if r.source == s)
            target = next(r.mix.target for r in got if r.source == s)
            assert abs(taken - target) <= 10, (long, s, taken, target)
