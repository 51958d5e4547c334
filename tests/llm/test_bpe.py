import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

from tests.llm.helpers import documents
from textforge.llm import bpe

PATH, PATTERN = bpe.default_vocabulary()
HOSTILE = [None, "", " ", "a", "it's 'S 'll don't", "x" * 5000, "ab" * 3000, "\n\n  \t x\x1c\x85 y ", "ààß 漢字 😀👩‍👧",
           "<|endoftext|>", "٣٤Ⅷ½", "\x00\x01", "".join(map(chr, range(32, 900)))]


def _library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library():
    enc, codec, rng = _library(), bpe.codec(PATH, PATTERN), random.Random(3)
    noise = ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x2FFF), rng.randint(0x1F300, 0x1F5FF)]))
                     for _ in range(400)) for _ in range(20)]
    for t in [x or "" for x in HOSTILE] + noise:
        ids = codec.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t)
        assert codec.decode(ids).decode() == t


def test_query_shape_and_round_trip(spark):
    texts = HOSTILE + [HOSTILE[4]]
    df = documents(spark, texts, extra=("ids", "n_tokens"))
    out = bpe.encode(df)
    enc = _library()
    for r in out.collect():
        t = texts[r.doc_id] or ""
        ids = np.array(enc.encode_ordinary(t), "<u4")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert {r.doc_id: r.text for r in bpe.decode(out).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.encode(df.limit(0)).count() == 0


def test_perfect_hash_is_minimal_and_rejects_strangers():
    keys = [str(i).encode() for i in range(3000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.get(k) for k in keys) == list(range(3000)) and None not in h.slots
    assert all(h.get(b"x%d" % i) == -1 for i in range(3000))
    assert bpe.PerfectHash([]).get(b"a") == -1
