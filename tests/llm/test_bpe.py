import hashlib
import random

import public_tokenizers
import pytest
import tokenizers

from remitgraph.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    own = tokenizers.Tokenizer.from_file(PATH)
    own.no_truncation()
    own.no_padding()
    return own


def texts():
    rng = random.Random(1)
    hard = ["<|startoftext|>", "<|endoftext|>", "'s", "'re", "I'LL", "  ", "\n", "12", "½", "x", "ΑΣ", "é", "'", "!'", "İ", "e\u0301", "\u3000"]
    out = ["", " ", "a" * 3000, "!" * 500, "'" * 7, "it's ''ll x'd"]
    for k in range(1500):
        out.append("".join(rng.choice(hard) for _ in range(8)) if k % 3 == 0 else
                   "".join(rng.choice("ab") for _ in range(rng.randint(1, 30))) if k % 3 == 1 else
                   "".join(rng.choice("etaoinshrdluцшäß中🌍!?.$#'") for _ in range(rng.randint(1, 60))))
    return out


def test_tokens_are_those_of_the_library(library):
    own, strings = bpe.encoder(PATH), texts()
    for text, ids in zip(strings, own.batch(strings).ids(), strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == expected, text
        assert own.decode(ids).decode() == library.decode(expected, skip_special_tokens=False)


def test_query_and_operators(spark, docs, library):
    rows = [(1, "Hello WORLD"), (1, "Hello WORLD"), (2, None), (3, ""), (None, "x"), (4, "lorem ipsum " * 5000)]
    frame = docs(rows)
    expected = sorted(
        (i is not None, i or 0, len(e := library.encode(t or "", add_special_tokens=False).ids),
         hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(),
         hashlib.sha256(library.decode(e, skip_special_tokens=False).encode()).hexdigest()) for i, t in rows)
    assert sorted((r[0] is not None, r[0] or 0, *r[1:]) for r in bpe.digests(frame, PATH).collect()) == expected
    tokens = bpe.encode(frame, PATH)
    decoded = {r.doc_id: r.decoded for r in bpe.decode(tokens, PATH).collect()}
    assert decoded[1] == "hello</w> world</w>" and decoded[2] == "" and decoded[3] == ""
    assert bpe.digests(frame.limit(0), PATH).collect() == []
