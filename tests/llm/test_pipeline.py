"""The pipeline's stages, each against a plain version on its own input."""

from __future__ import annotations

import re
import zlib

import numpy as np
from test_methods import check_packing, components, fingerprint

import corpus_pipeline
from stintflow.llm import decontaminate, packing, toxicity


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, seen[-1], sf).write.parquet(path)
        seen.append(spark.read.parquet(path))
    assert all(d.columns == columns for d in seen[:-1])
    text = [{r.doc_id: r.text for r in d.collect()} for d in seen[:-1]]
    raw, clean, unique, kept, hidden = text

    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(clean[d] == raw[d] for d in clean)
    assert sum(d in clean for d, t in labels.items() if t == 0) >= 0.97 * sum(t == 0 for t in labels.values())
    assert sum(d not in clean for d, t in labels.items() if t == 1) >= 0.5 * sum(t == 1 for t in labels.values())

    fp = {d: fingerprint(t) for d, t in clean.items()}
    ids = sorted(fp)
    want = components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 4])
    assert set(unique) == {d for d, c in want.items() if d == c}

    items = [decontaminate.compared(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    whole = {d for d, t in unique.items() if any(b" " + b" ".join(i) + b" " in b" " + b" ".join(decontaminate.compared(t)) + b" " for i in items)}
    assert not whole & set(kept) and len(kept) >= len(unique) - len(whole) - 3

    assert set(hidden) == set(kept)
    changed = [d for d in kept if hidden[d] != kept[d]]
    assert changed and all(re.search("[0-9@]", kept[d]) for d in changed)
    assert not any(m in hidden[d] for d in kept for m in re.findall(r"[a-z.0-9]+@mail[0-9]+\.example\.com", kept[d]))
    assert {r.doc_id: r.n_chars for r in seen[4].collect()} == {d: len(t) for d, t in hidden.items()}

    rows = seen[5].collect()
    assert check_packing(rows, packing.Limits()) <= 1 - (-sum(r.length for r in rows) // 4096)
    tok = packing.tokenizer_of(packing._default_tokenizer())
    want = {d: np.append(np.frombuffer(tok.encode([t])[0], "<u4"), np.uint32(1)) for d, t in hidden.items()}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == {(d, k): (s, len(x[s : s + 4096]), zlib.crc32(x[s : s + 4096].astype("<u4").tobytes())) for d, x in want.items() for k, s in enumerate(range(0, len(x), 4096))}


def test_run_gives_the_last_stage(spark, sf):
    df = corpus_pipeline.run(spark, sf)
    assert df.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and df.count() > 0


def test_threshold_is_where_f1_is_best():
    p, y = np.array([0.9, 0.8, 0.3, 0.2, 0.1]), np.array([1.0, 1.0, 1.0, 0.0, 0.0])
    assert toxicity.best_threshold(p, y) == 0.25
