import pytest

from compare import same
from speechmill.functions import text
from speechmill.plans import corpus, media, relational, sequences, signals

SQL = {**corpus.oracle_sql(), **relational.oracle_sql(), **media.oracle_sql(), **signals.oracle_sql(), **sequences.oracle_sql()}
QUERIES = {**corpus.queries(), **relational.queries(), **media.queries(), **signals.queries(), **sequences.queries()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_are_those_of_the_sql(spark, sf_dir, name):
    same(spark, sf_dir, QUERIES[name], SQL[name])


def test_others_have_a_brute_force():
    import test_whole_tables

    assert {f"test_{name}" for name in set(QUERIES) - set(SQL)} <= set(dir(test_whole_tables))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["script_sentences", "sentence_explode", "lexicon_label", "block_merge"])
def test_texts_are_split_once(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(text.QUICK_SENTENCE) == 1
