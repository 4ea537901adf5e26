"""A worker keeps the models of one operator at a time."""

import pyarrow as pa

from quillspark.llm import quality, tokens, worker
from quillspark.llm.queries import byte_level, vocabulary
from quillspark.llm.quality import BANDS, _measured


def test_models_of_one_operator_at_a_time():
    path = vocabulary("word_bpe_49k.json")
    texts = pa.array(["some words of a text", None, ""])
    before = tokens.text_ids(path, texts)
    assert tokens.tokenizer.cache_info().currsize == 1
    bands = {k: vars(v) for k, v in BANDS.items()}
    part = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), texts, pa.array(["en", "en", None])], names=["doc_id", "text", "lang"])
    _measured(vocabulary("piece_bpe_32k.model"), byte_level(), bands)(part)
    assert tokens.tokenizer.cache_info().currsize == 0 and not tokens._known
    again = tokens.text_ids(path, texts)
    assert quality._model.cache_info().currsize == 0 and quality._byte_level.cache_info().currsize == 0
    assert [x.tolist() for x in before] == [x.tolist() for x in again]


def test_release_keeps_what_is_in_use():
    held = pa.array(range(1000))
    worker.release()
    assert held.to_pylist() == list(range(1000))
