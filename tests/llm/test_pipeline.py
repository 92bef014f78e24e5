import os
import shutil

import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet as pq
from conftest import SMALL
from fixtures import documents, empty
from oracle import rows_of_duckdb

from lectern.llm.queries import OP1_SQL, OP2_SQL, OP9_SQL, op8_toxicity, tokenizer
from lectern.session import table


def stored(rows: dict, folder) -> str:
    """doc_id -> text as a documents table beside the benchmark."""
    os.makedirs(folder)
    pq.write_table(pa.table({"doc_id": pa.array(list(rows), pa.int64()), "text": pa.array(list(rows.values()), pa.string())}), f"{folder}/documents.parquet")
    shutil.copy(f"{SMALL}/benchmark.parquet", f"{folder}/benchmark.parquet")
    return str(folder)


def by_sql(sql, folder):
    names, rows = rows_of_duckdb(sql, folder)
    return [dict(zip(names, r)) for r in rows]


def test_every_stage_against_its_rule(spark, tmp_path):
    """What each stage leaves of all that its predecessor kept, by the query's result, by SQL or by the tokenizer itself."""
    from tokenizers import Tokenizer

    docs = table(spark, SMALL, "documents")
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = {r["doc_id"] for r in op8_toxicity(spark, SMALL).where("predicted = 1").collect()}
    expected = {k: t for k, t in left.items() if k not in toxic}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        kept = stage(spark, docs, SMALL).cache()
        assert kept.columns == docs.columns
        found = {r["doc_id"]: r["text"] for r in kept.collect()}
        if number:
            folder = stored(left, tmp_path / name)
            if name == "line_dedup":
                expected = {r["doc_id"]: r["text"] for r in by_sql(OP9_SQL, folder)}
            elif name == "near_duplicates":
                classes = {r["class_id"] for r in by_sql(OP2_SQL, folder)}
                expected = {k: t for k, t in left.items() if k in classes}
            else:
                tainted = {r["doc_id"] for r in by_sql(OP1_SQL, folder)}
                expected = {k: t for k, t in left.items() if k not in tainted}
        assert found == expected and len(found) == kept.count(), name
        assert all(r["n_chars"] == len(r["text"]) for r in kept.collect())
        docs, left = kept, found
    encoder = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    pieces, sequences = {}, {}
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect():
        pieces[r["doc_id"]] = pieces.get(r["doc_id"], 0) + r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert pieces == {k: len(encoder.encode(t, add_special_tokens=False).ids) + 1 for k, t in left.items()}
    for parts in sequences.values():
        ends = [0, *[offset + length for offset, length in sorted(parts)]]
        assert ends[:-1] == [offset for offset, _ in sorted(parts)] and ends[-1] <= 2048


def test_awkward_and_empty_documents(spark):
    for docs in (documents(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, docs, SMALL)
            assert name == "packing" or rows.columns == docs.columns
            assert docs.isEmpty() == (rows.count() == 0)


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
