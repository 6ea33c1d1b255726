"""The pipeline stage by stage, and the queries of this package."""

import random
import re
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tallyloom.llm import quality, queries, subwords
from tallyloom.session import settle

from .test_simhash import plain_fingerprint, plain_groups
from .test_weak import plain_base

NAMES = ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "PII", "packing"]


def plain_mask(text):
    out, at = [], 0
    for start, kind, end in plain_base(text):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def test_stages_against_plain_versions(spark, corpus, folder):
    assert [name for name, _ in corpus_pipeline.STAGES] == NAMES and corpus_pipeline.ORACLE_SQL is None
    stages = [stage for _, stage in corpus_pipeline.STAGES]
    items = [row.text for row in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = [tuple(row) for row in corpus.collect()]
    dice = random.Random(1)
    normal = [row for row in rows if len(row[1].split()) > 150]
    planted = []
    for k in range(10):
        text = dice.choice(normal)[1]
        planted.append((5000 + k, text, "en", "s", len(text)))  # an exact copy
        planted.append((6000 + k, f"{text} {dice.choice(items)}", "en", "s", 0))  # a leak
        planted.append((7000 + k, f"{text} someone{k}@mail.example.com", "en", "s", 0))  # a near copy
    docs = spark.createDataFrame(rows + planted + [(9000, None, None, None, None), (9001, "", None, None, 0)], corpus.schema)

    judged = settle(stages[0](spark, docs, folder))
    assert judged.columns == docs.columns
    kept = {row.doc_id for row in quality.judge(docs).collect() if row.keep}
    assert {row.doc_id for row in judged.collect()} == kept and not kept & {9000, 9001}

    single = settle(stages[1](spark, judged, folder))
    ids = sorted(row.doc_id for row in judged.collect())
    texts = {row.doc_id: row.text for row in judged.collect()}
    groups = plain_groups([plain_fingerprint(texts[i]) for i in ids], ids)
    assert sorted(row.doc_id for row in single.collect()) == sorted(set(groups)) and single.columns == docs.columns

    clean = settle(stages[2](spark, single, folder))
    plain = lambda text: " ".join(text.lower().split())
    leaky = {i for i in set(groups) if any(plain(item) in plain(texts[i]) for item in items)}
    assert {row.doc_id for row in clean.collect()} == set(groups) - leaky and clean.columns == docs.columns

    masked = settle(stages[3](spark, clean, folder))
    assert masked.columns == docs.columns
    for row in masked.collect():
        # Spans beyond the base may be masked too; each leaves its mark.
        assert row.text == plain_mask(texts[row.doc_id]) or re.search("<(EMAIL|PHONE|CARD|IBAN|SSN)>", row.text)
        assert row.n_chars == len(row.text) and "@mail.example" not in row.text

    packed = stages[4](spark, masked, folder).toPandas()
    coder = subwords.encoder(subwords.vocabulary_path())
    sizes = {row.doc_id: len(coder.encode([row.text.encode()])[0]) + 1 for row in masked.collect()}
    assert packed.groupby("doc_id")["length"].sum().to_dict() == sizes
    assert packed.groupby("sequence_id")["length"].sum().max() <= 2048


def test_run_applies_all_stages_to_documents(spark, folder, nothing, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, folder))
    found = corpus_pipeline.run(spark, folder)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, docs.select(columns).collect()))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_messy_and_empty_tables(spark, folder, messy, nothing, name, stage):
    assert stage(spark, nothing, folder).count() == 0
    found = stage(spark, messy, folder)
    assert found.count() > 0
    if name != "packing":
        assert found.columns == messy.columns


def test_every_operator_has_its_query(spark, folder):
    names = sorted(queries.QUERIES, key=lambda name: int(name[2:].split("_")[0]))
    assert [name.split("_")[0] for name in names] == [f"op{n}" for n in range(1, 14)]
    assert set(names) | {"pipeline"} <= set(entry.queries())
    for name in names:
        assert queries.QUERIES[name](spark, folder).count() > 0


def test_the_library_works_without_this_package():
    top = Path(entry.__file__).parent
    code = (
        "import sys; sys.modules['tallyloom.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e\n"
        "assert not [n for n in e.queries() if n.startswith('op') or n == 'pipeline']\n"
        "assert set(e.queries()) == set(e.oracle_sql())"
    )
    subprocess.run([sys.executable, "-c", code], cwd=top, check=True, timeout=120)
    for source in (top / "tallyloom").rglob("*.py"):
        if "llm" not in source.relative_to(top).parts:
            assert "llm" not in source.read_text()
