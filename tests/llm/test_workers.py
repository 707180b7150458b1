"""What Python workers keep, and the files that small tables make."""

import public_tokenizers
import pyarrow as pa

from corpusloom.llm import bpe, near_dedup, rows
from corpusloom.llm.words import HASHES
from corpusloom.llm.workers import trimmed

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_words_of_one_operator_at_a_time():
    """A worker of a pipeline has the words of near-dedup or those of packing, with the same results."""
    one, texts = bpe.WordBpe(PATH), ["some words of a text", "and of another one"]
    ids = one.encode(texts)
    hashes = HASHES.of([b"some", b"words"])
    assert set(HASHES) == {b"some", b"words"} and not one.words
    assert one.encode(texts) == ids
    assert one.words and not HASHES
    assert (HASHES.of([b"some", b"words"]) == hashes).all() and not one.words


def test_trimmed_batches():
    batches = [pa.RecordBatch.from_pydict({"x": list(range(n))}) for n in (3, 0, 2)]
    assert [b.num_rows for b in trimmed(iter(batches))] == [3, 0, 2] and list(trimmed(iter([]))) == []


def test_comparison_takes_batches_one_by_one():
    """A task gives the pairs of its first nodes before it has read the last ones."""
    taken = []

    def batches():
        for k in range(8):
            taken.append(k)
            columns = {"node": [k, k], "rep": [2 * k, 2 * k + 1], "component": [2 * k, 2 * k + 1]}
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns.values()), pa.array([bytes(24)] * 2, pa.binary())], [*columns, "sketch"])

    found = near_dedup._exhaustive(near_dedup.BINS)(batches())
    first = next(found)
    assert len(taken) < 8
    got = [(r["a"], r["b"]) for b in [first, *found] for r in b.to_pylist()]
    assert got == [(2 * k, 2 * k + 1) for k in range(8)]


def test_kept_rows_make_few_files(spark, tmp_path, monkeypatch):
    """Places of rows come from a shuffle with as many partitions as it likes; each was a file, for which Spark starts other processes."""
    spark.range(300).withColumnRenamed("id", "doc_id").coalesce(2).write.parquet(f"{tmp_path}/docs")
    _, docs = rows.numbered(spark.read.parquet(f"{tmp_path}/docs"))
    files, write = [], rows.write_table

    def counted(*args, **more):
        out = write(*args, **more)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(rows, "write_table", counted)
    kept = docs.where("doc_id % 3 > 0").repartition(64, "doc_id")
    assert sorted(r.doc_id for r in rows.only(docs, kept).collect()) == [i for i in range(300) if i % 3]
    assert max(files) <= rows.TASKS
