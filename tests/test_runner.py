"""A run from raw files to reports, and one that fails."""

import json

import numpy as np
import pytest

from lexweave import runner as R


@pytest.fixture(scope="module")
def out(spark, tmp_path_factory):
    rng, raw, out = np.random.default_rng(1), tmp_path_factory.mktemp("raw"), tmp_path_factory.mktemp("out")
    topics = [["river", "water", "fishing", "boats"], ["street", "driver", "engine", "wheels"], ["garden", "flower", "spring", "leaves"]]
    for k in range(60):
        lines = " ".join(" ".join(["Today", *rng.permutation(topics[k % 3])[:3], f"item{rng.integers(9)}x", "together"]) + "." for _ in range(12))
        (raw / f"d{k:02}.txt").write_text(f"SOURCE_URL: http://h.x/{k}\n\n{lines}\nHome\n")
    run = R.Run(spark, f"file://{raw}", f"file://{out}", training={"dim": 8, "epochs": 2, "parts": 2, "blocks": 2}, probes=("river", "engine", "nowhere"),
                analogies={"one": (("river", "driver"), ("water",), ("street", "engine")), "lost": (("nowhere",), ("river",), ("x",))}, groups={"a": ("river", "water", "boats", "fishing"), "b": ("street", "engine", "driver", "gone")})
    assert R.execute(run) == ["corpus", "statistics", "models", "semantics", "projections", "comparison"]
    return out


def rows(out, name):
    return [json.loads(x) for f in sorted((out / name).glob("*.json")) for x in f.read_text().splitlines()]


def test_corpus_and_statistics(out):
    lines = [x for f in sorted((out / "corpus").glob("part*")) for x in f.read_text().splitlines()]
    assert lines and len(lines) == len(set(lines)) and all(x.startswith("today ") for x in lines)
    (total,) = rows(out, "summary")
    assert total["total_sentences"] == len(lines) == sum(r["sentences"] for r in rows(out, "metadata"))
    top = sorted(rows(out, "top_words"), key=lambda r: r["rank"])
    assert top[0]["weight"] == 1.0 and {r["word"] for r in top[:2]} == {"today", "together"}


def test_models_and_reports(out):
    assert {(r["model"], r["epoch"]) for r in rows(out, "losses")} == {(m, e) for m in ("cbow", "skipgram") for e in (1, 2)}
    near = rows(out, "neighbours")
    assert {(r["model"], r["probe"]) for r in near} == {(m, p) for m in ("cbow", "skipgram") for p in ("river", "engine")} and len(near) == 20
    assert {(r["of"], r["word"]) for r in rows(out, "missing")} == {("probe", "nowhere"), ("lost", "nowhere")}
    assert {r["label"] for r in rows(out, "analogies")} == {"one"} and sorted(r["answered"] for r in rows(out, "hits")) == [1, 1]
    assert {r["probe"] for r in rows(out, "agreement")} == {"river", "engine"}
    assert len(rows(out, "projections")) == 2 * 2 * 7
    (cka,) = rows(out, "cka")
    assert (cka["model_a"], cka["model_b"]) == ("cbow", "skipgram") and 0 < cka["cka"] <= 1


def test_first_failure_ends_the_run(spark, tmp_path):
    def broken(run):
        raise ValueError("no")

    def never(run):
        raise AssertionError

    with pytest.raises(R.StepFailed, match="step broken failed after none") as e:
        R.execute(R.Run(spark, "", f"file://{tmp_path}"), (broken, never))
    assert isinstance(e.value.__cause__, ValueError)
