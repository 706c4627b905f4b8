"""What operators keep in a worker process, which Spark hands on from stage to stage."""

import gc
import weakref

import pyarrow as pa
import pytest

import corpus_pipeline
from meridian.llm import common, decontam, near_dups, packing, quality, tokens
from meridian.llm.tokens import encoder, public_path
from tests.llm.conftest import prose

PATH = "byte_bpe_50k.json"


class Tasks:
    """Stands for documents(doc_id, text) and gives the function that a task runs over its batches."""

    columns, schema = ["doc_id", "text"], None

    def select(self, *names):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return lambda: list(run(iter([pa.record_batch([pa.array([1, 2]), pa.array([prose(50, 1), None])], names=self.columns)])))


@pytest.fixture
def tasks(tmp_path):
    path = f"file://{tmp_path}/index.npz"
    decontam.build([(1, "What is the capital of a far land? It is a town by the sea.")]).save(path)
    return {
        "judge": quality.judge(Tasks()),
        "kept_documents": quality.kept_documents(Tasks()),
        "sketches": near_dups.sketches(Tasks(), 5, 4, 5),
        "loaded": lambda: decontam.loaded(path),
    }


@pytest.mark.parametrize("name", ["judge", "kept_documents", "sketches", "loaded"])
def test_an_encoder_goes_when_tasks_of_another_operator_come(tasks, name):
    """It takes some 100 MB with a full cache of pieces, beside what the other operator needs."""
    held = weakref.ref(encoder(public_path(PATH)))
    held().ids(prose(200, 3))
    gc.collect()
    assert held() is not None
    assert tasks[name]()
    gc.collect()
    assert held() is None


def test_tasks_of_one_operator_share_what_it_keeps(tasks):
    assert encoder(public_path(PATH)) is encoder(public_path(PATH))
    assert tasks["loaded"]() is tasks["loaded"]()


def test_the_pipeline_packs_with_a_smaller_cache_and_the_same_result(spark):
    frame = spark.createDataFrame([(i, prose(300, i)) for i in range(40)], "doc_id long, text string").coalesce(1)
    stage = dict(corpus_pipeline.STAGES)["packing"]
    got = stage(spark, frame, "").collect()
    assert sorted(got) == sorted(packing.pack(frame, public_path(PATH)).drop("cost").collect())
    assert sum(r["length"] for r in got) == sum(len(encoder(public_path(PATH)).ids(r["text"])) + 1 for r in frame.collect())
    assert corpus_pipeline.PIECES < tokens.CACHE_PIECES
    assert encoder(public_path(PATH), corpus_pipeline.PIECES).pieces.limit == corpus_pipeline.PIECES // 2 and len(common._KEPT) == 1
