"""The pipeline's stages against what they are made of, on a sample small enough to check by hand."""

import re

import corpus_pipeline as P
import pyarrow as pa
from pyspark.sql import functions as F
from tests.llm.helpers import awkward, shown
from tests.llm.test_near_duplicates import brute
from tokenizers import Tokenizer

from trailmark.llm.common import vocabulary

SF = "/root/testdata/sf0.001"


def test_every_stage_on_the_smallest_sample(spark, tmp_path):
    plain = Tokenizer.from_file(vocabulary()["json_path"])
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = []
    for i, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if i < len(P.STAGES) - 1:
            assert docs.columns == list(P.COLUMNS)
        frames.append(shown(docs))
    given = shown(spark.read.parquet(f"{SF}/documents.parquet"))
    kept, unique, clean, private, packed = frames
    assert {r["doc_id"] for r in kept} == {r["doc_id"] for r in given if re.search(r"[^\W\d_]", r["text"])}
    groups = brute([(r["doc_id"], r["text"]) for r in kept], 5, 80)
    assert {r["doc_id"] for r in unique} == {g[0] for g in groups if g[0] == g[2]}
    items = [r["text"] for r in shown(spark.read.parquet(f"{SF}/benchmark.parquet"))]
    copies = {r["doc_id"] for r in unique if any(i in r["text"] for i in items)}
    gone = {r["doc_id"] for r in unique} - {r["doc_id"] for r in clean}
    assert copies <= gone and len(gone) <= len(copies) + 2
    before = {r["doc_id"]: r["text"] for r in clean}
    secret = re.compile(r"\S+@\S+|\b\d{16}\b|\b\d+\.\d+\.\d+\.\d+\b|AKIA\w+|password=\w+")
    for r in private:
        assert r["n_chars"] == len(r["text"]) and not set(secret.findall(before[r["doc_id"]])) & set(secret.findall(r["text"]))
    want = {r["doc_id"]: [*plain.encode(r["text"], add_special_tokens=False).ids, 1] for r in private}
    found = {}
    for r in sorted(packed, key=lambda r: (r["doc_id"], r["start"])):
        found.setdefault(r["doc_id"], []).extend(r["tokens"])
    assert found == want


def test_a_bare_guess_goes_with_any_number_of_languages(spark):
    """Texts in a script that no learned language has are guesses; those of a learned one stay."""
    said = {"en": "the cat and the dog are here", "de": "der Hund und die Katze sind hier", "es": "el perro y el gato", "fr": "le chien et la souris", "it": "il cane con lo gatto", "nl": "de hond en het paard"}
    for n in (1, 2, 3, 6):
        rows = [(3 * i + k, said[lang], lang, "s", 1) for i in range(6) for k, lang in enumerate(list(said)[:n])] + [(900, "ψωμί και νερό", None, "s", 1), (901, "123 ...", None, "s", 1)]
        kept = {r["doc_id"] for r in shown(P.language_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF))}
        assert kept == {r[0] for r in rows if r[0] < 900} | ({900} if n == 1 else set())


def test_run_and_awkward_rows(spark, tmp_path):
    folder = str(tmp_path / "sf")
    awkward(spark).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    assert P.run(spark, folder).count() > 0
    empty = str(tmp_path / "empty")
    awkward(spark).limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").limit(0).write.parquet(f"{empty}/benchmark.parquet")
    assert P.run(spark, empty).count() == 0


def test_tables_are_written_from_small_arrow_batches(spark):
    from trailmark.llm.common import WRITING, Staging

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    before = {key: spark.conf.get(key, None) for key in WRITING}
    kept = Staging(spark).keep(spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long"), "sizes")
    assert kept.agg(F.max("n"), F.sum("n")).first() == (1000, 5000)
    assert {key: spark.conf.get(key, None) for key in WRITING} == before


def test_a_stage_is_written_by_its_caller_from_small_arrow_batches(spark):
    from trailmark.llm.common import WRITING

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    before = {key: spark.conf.get(key, None) for key in WRITING}
    try:
        for _, stage in P.STAGES[3:]:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
            stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
            assert spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long").agg(F.max("n"), F.sum("n")).first() == (1000, 5000)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
