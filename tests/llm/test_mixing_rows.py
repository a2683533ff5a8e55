"""mix() on rows without doc_id and rows that repeat one: each source still gets its target."""

from quire.llm import mixing


def test_rows_without_an_id_of_their_own_are_mixed(spark):
    ids = lambda i: None if i % 3 == 0 else 7 if i % 3 == 1 else i
    rows = [(ids(i), " ".join(f"w{i}" for _ in range(5 + i % 40)), "en", "abc"[i % 7 % 3], i) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    goals = {r.source: r for r in mixing.targets(docs.selectExpr("source", "cast(size(split(text, ' ')) as long) as size")).collect()}
    out = mixing.mix(docs).collect()
    assert {r.doc_id for r in out} >= {None, 7}
    for source, goal in goals.items():
        got = sum(len(r.text.split()) for r in out if r.source == source)
        assert abs(got - goal.target) <= 44  # its largest document
    times = {}
    for r in out:
        times[r.n_chars] = times.get(r.n_chars, 0) + 1
    assert max(times.values()) <= 3
