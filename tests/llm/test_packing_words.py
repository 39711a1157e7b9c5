"""Words of the packing encoder against the whole tokenizer, and the shapes of items."""

from __future__ import annotations

import numpy as np
import public_tokenizers

from tradegrain.llm import common, packing


def test_every_kind_of_word_is_tokenized_as_in_the_whole_text():
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    text = "plain Upper MiXed. comma, é. École, ÀÉÎ. straße ×. a÷, été. Жук. 漢字, x1. ... , . don't. <|no|>. ǅ. µ, ª"
    encode = packing.document_encoder(file, end_id=2)()
    (ids, _), (none, _) = encode([(text,), (None,)])
    assert ids.tolist() == [*Tokenizer.from_file(file).encode(text, add_special_tokens=False).ids, 2]
    assert none.tolist() == [2]


def test_merges_alone_give_the_ids_of_the_whole_tokenizer():
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, merges = Tokenizer.from_file(file), packing._merge_encoder(file)
    entries = [e.removesuffix("</w>") for e in tokenizer.get_vocab()]
    words = sorted({e for e in entries if e.isascii() and e.isalpha() and e.islower()})
    words += [a + b for a, b in zip(words, reversed(words), strict=True)] + ["straße", "éàîœ", "жук", "漢字", "a" * 900]
    found = merges.encode_ordinary("".join(w + " " for w in words))
    assert found == [i for one in tokenizer.encode_batch(words, add_special_tokens=False) for i in one.ids]


def test_other_vocabularies_do_without_merges(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    plain = Tokenizer(models.BPE({"a": 0, "b": 1, "ab": 2, ".": 3, ",": 4}, [("a", "b")]))
    plain.pre_tokenizer = pre_tokenizers.Whitespace()
    plain.save(str(tmp_path / "one.json"))
    assert packing._merge_encoder(str(tmp_path / "one.json")) is None
    encode = packing.document_encoder(str(tmp_path / "one.json"), end_id=9)()
    assert encode([("ab ba. ab,",)])[0][0].tolist() == [2, 1, 0, 3, 2, 4, 9]


def test_plain_words_are_found_together():
    words = "lower word. Upper x1 été, École ÷. a÷ . ,a é. . don't. жук ª a.. <|a. end.".split()
    letters, plain, stop = packing._plain_words([w.encode() for w in words], packing.STOPS)
    assert letters.decode() == "lower word été école é end "
    assert [w for w, p in zip(words, plain, strict=True) if p] == ["lower", "word.", "été,", "École", "é.", "end."]
    assert bytes(stop[plain].tolist()) == b"\0.,\0.."
    assert not stop[~plain].any()


def test_an_item_counts_its_tokens_once():
    item = packing.Item(1, 0, np.arange(5, dtype=np.uint32), np.array([1, 0, 1, 1, 0], dtype=bool), 5)
    head, tail = item.cut(2)
    assert item.shape == (5, 3) and head.shape == (2, 1) and tail.shape == (3, 2)


def test_memory_of_kept_things_goes_back_to_the_system(monkeypatch):
    """Arrays below a later one stayed with the process after they were freed."""

    def held() -> int:
        with open("/proc/self/statm") as file:
            return int(file.read().split()[1]) * 4096

    monkeypatch.setattr(common, "_KEPT", {})
    common._KEPT["many"] = [np.ones(500) for _ in range(50_000)]
    later = [np.ones(500) for _ in range(100)]
    before = held()
    assert not list(common.slices(iter([])))
    assert not common._KEPT and len(later) == 100 and held() < before - 100_000_000
