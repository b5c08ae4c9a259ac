from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tripleval.functions.prompts import extract_answer
from tripleval.operators.triplets import facts_to_triplets, parse_prompt, render_prompt


def test_render_golden(spark):
    df = spark.createDataFrame([(1, " a ", "b\n", " c")], "triplet_id long, observations string, question string, "
                                                           "answer string")
    r = render_prompt(df).first()
    assert r.prompt == "Training Observations:\na\n\nQuestion:\nb\n\nAnswer:\n"
    assert r.response == "c"
    assert r.text == r.prompt + "c"


def test_extract_answer_table(spark):
    rows = [("P Answer:\n", "P Answer:\n yes \nmore", "yes"),
            ("P", "x Answer: a Answer: b\nc", "b"),
            ("P", "no marker\nz", "no marker"),
            ("P", "P", "")]
    df = spark.createDataFrame([r[:2] for r in rows], "prompt string, full string")
    got = [r[0] for r in df.select(extract_answer(F.col("prompt"), F.col("full"))).collect()]
    assert got == [r[2] for r in rows]


_text = st.text(alphabet=st.characters(blacklist_categories=("Cs",), blacklist_characters="\r"), max_size=30) \
    .filter(lambda s: "Question:\n" not in s and "Answer:" not in s and "Training Observations:\n" not in s)


@settings(max_examples=25, deadline=None)
@given(obs=_text, q=_text, a=_text)
def test_parse_inverts_render(spark, obs, q, a):
    df = spark.createDataFrame([(1, obs, q, a)], "triplet_id long, observations string, question string, "
                                                 "answer string")
    r = parse_prompt(render_prompt(df)).first()
    assert (r.observations, r.question, r.reference, r.parse_ok) == (obs.strip(), q.strip(), a.strip(), True)


def test_parse_without_marker(spark):
    df = spark.createDataFrame([(1, "no markers here", "x", "")], "example_id long, prompt string, response string, "
                                                                   "text string")
    r = parse_prompt(df).first()
    assert r.parse_ok is False and r.question == ""


def test_facts_to_triplets_nan_and_order(spark):
    cols = ["fact 1.1", "fact 1.2", "fact 2.1", "fact 2.2", "fact 3.1", "fact 3.2", "rule template", "rule type",
            "rule"]
    schema = "fact_id long, " + ", ".join(f"`{c}` string" for c in cols)
    df = spark.createDataFrame([(7, "a", None, "b", "c", None, "d", None, "T", "R")], schema)
    r = facts_to_triplets(df).first()
    assert r.observations == "ananbcnand"
    assert r.question == ("Can you infer a general rule from the observations of type T and template nan?")
    assert r.answer == "R" and r.dataset == "od"


def test_batches_of_long_texts_come_in_steps(spark):
    from tripleval.operators import generate

    rows = [("id", i, "x" * (1 << 20), "q" if i else None, None) for i in range(12)]
    inputs = spark.createDataFrame(rows, "distribution string, example_id long, observations string, question string, reference string").coalesce(1)

    def factory():
        return lambda batch: batch["question"].fillna("none") + f" {len(batch)}"

    got = sorted((r.example_id, r.full_text) for r in generate.generate_with(inputs, "m", factory).collect())
    assert [e for e, _ in got] == list(range(12)) and got[0][1].startswith("none ")
    assert max(int(t.split()[1]) for _, t in got) <= 4      # a row is 2 MB of text, a step 8 MB
    both = generate.generate_with_variants(inputs.withColumn("answer", F.lit(None).cast("string")), "m", factory).collect()
    assert len(both) == 24 and max(int(r.full_text.split()[1]) for r in both) <= 4
