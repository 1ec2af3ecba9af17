"""Ranges of files that tasks take together."""

from corvane.sources import element_source


def test_a_task_takes_many_ranges(spark, tmp_path, monkeypatch):
    """Small ranges make few tasks; each element is still read once, in the range its blank line begins in."""
    texts = [f"Paragraph {k}, which ends.\n- and {'more ' * (k % 9)}" for k in range(400)]
    for n in range(2):
        (tmp_path / f"f{n}.txt").write_text("\n\n".join(texts[n::2]) + "\n")
    element_source.register(spark)
    rows = spark.read.format("corvane_elements").option("split_bytes", 64).load(str(tmp_path))
    assert rows.rdd.getNumPartitions() == 1
    assert sorted(r.text for r in rows.collect()) == sorted(t.rstrip() for t in texts)
    reader = element_source.ElementReader({"path": str(tmp_path), "split_bytes": "64"})
    monkeypatch.setattr(element_source, "TASK_BYTES", 1000)
    tasks = reader.partitions()
    assert len(tasks) > 5 and all(sum(end - start for _, start, end in t.parts) <= 1000 for t in tasks)
    assert sum(b.num_rows for t in tasks for b in reader.read(t)) == 400
