"""Keeping one row of each group does not shuffle the documents' texts."""

from factspark.llm import simhash


def test_texts_are_not_shuffled(spark, capsys):
    docs = [(i, f"text of document {i % 40} with words of its own {i % 40 * 7919} and {i % 40 * 104729}") for i in range(60)]
    df = spark.createDataFrame([*docs, (3, docs[3][1]), (5, "a"), (None, "nameless text"), (None, docs[9][1])], "doc_id long, text string")
    broadcasts = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.keep_one_of_each(df.filter("doc_id is not null"))
        kept.explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcasts)
    assert "SortMergeJoin" not in capsys.readouterr().out
    rows = simhash.keep_one_of_each(df).collect()
    groups = {r.doc_id: r.component_id for r in simhash.near_groups(df).collect()}
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(i for i, g in groups.items() if i is not None and i == g)
    assert [r.text for r in rows if r.doc_id is None] == ["nameless text"]
