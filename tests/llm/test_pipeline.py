"""The pipeline against a plain Python version, the edge table through every stage, and the import guard."""

import math
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from test_decontamination import contained
from test_native import brute_shards, targets
from test_simhash import brute_fingerprint, near_components

import corpus_pipeline
from varicube.llm import quality

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


def coin(doc_id):
    import hashlib

    return int(hashlib.md5(f"mix:{doc_id}".encode()).hexdigest()[:8], 16) / 2**32


def test_run_by_brute_force(spark, documents):
    got = corpus_pipeline.run(spark, SF).collect()
    rows = {r["doc_id"]: r for r in documents.collect()}
    model = quality.fit(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = [(r["text"] or "").encode() for r in rows.values()]
    kept = {i: rows[i] for i, s in zip(rows, model.scorer()(texts)) if s >= 0.3}
    roots = near_components({i: [brute_fingerprint(r["text"], 5, t) for t in range(32)] for i, r in kept.items()})
    kept = {i: r for i, r in kept.items() if roots[i] == i}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {i: r for i, r in kept.items() if not any(contained(r["text"], t) >= 0.8 for t in items)}
    sizes, by_source = {i: len((r["text"] or "").encode().split()) for i, r in kept.items()}, defaultdict(int)
    for i, r in kept.items():
        by_source[r["source"]] += sizes[i]
    target = targets(by_source)
    copies = {}
    for i, r in kept.items():
        rate = target[r["source"]] / by_source[r["source"]] if by_source[r["source"]] else 0
        copies[i] = math.floor(rate + 1e-12) + (coin(i) < rate - math.floor(rate + 1e-12))
    want = Counter({i: n for i, n in copies.items() if n})
    assert Counter(r["doc_id"] for r in got) == want
    assert all(r["text"] == rows[r["doc_id"]]["text"] for r in got)
    placed = brute_shards([(r["doc_id"], r["text"], r["source"]) for r in got])
    assert sorted([(r["doc_id"], r["shard"], r["slot"]) for r in got], key=str) == placed


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_edges(spark, edge, empty, stage):
    name, function = corpus_pipeline.STAGES[stage]
    for frame in (edge, empty):
        out = function(spark, frame, SF)
        assert out.columns[: len(frame.columns)] == frame.columns
        assert stage == 4 or out.columns == frame.columns
        rows = out.collect()
        assert frame is edge or not rows


def test_entry_without_the_operators(tmp_path):
    """The library's entry module works where the operators and the pipeline are not there."""
    for name in ("__spark_entry__.py", "varicube"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    package = tmp_path / "varicube"
    package.mkdir()
    for path in (ROOT / "varicube").iterdir():
        if path.name not in ("llm", "__pycache__"):
            (package / path.name).symlink_to(path)
    entry = (ROOT / "__spark_entry__.py").read_text()
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text(entry)
    code = "import __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith('op') and q[2].isdigit()], 1; assert 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)} | dict(__import__("os").environ, PYTHONPATH=str(tmp_path)))
