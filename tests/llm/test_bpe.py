"""BPE against the tokenizers library and round trips."""

import hashlib
import random
import unicodedata

from tokenizers import Tokenizer

from parchment.llm import bpe

DATA = "/root/testdata/sf0.001"
PATH = bpe.vocabulary()


def library(texts):
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    ids = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    return ids, [t.decode(i, skip_special_tokens=False) for i in ids]


def ours(texts):
    import numpy as np

    t = bpe.Tokenizer(PATH)
    ids = [np.frombuffer(x, np.int32).tolist() for x in t.encode(texts)]
    return ids, [t.decode(i) for i in ids]


def test_random_and_awkward_texts():
    rng = random.Random(3)
    texts = ["", " ", "\n\n  x", "aaaaaaaaaaaaaaaaa", "<|endoftext|>", "a<|endoftext|><|endoftext|> b <|endoftext", "don't I'll we've", "  x\x1c y\x85z", "日本語 テキスト 123 ½ ²", "é́ ‍👩‍👩‍👧"]
    alphabet = "abcdeth  \n\t'.,!?0123éßñ中🙂"
    texts += ["".join(rng.choices(alphabet, k=rng.randint(1, 300))) for _ in range(300)]
    texts.append("the and ing tion " * 20_000)
    assert ours(texts) == library(texts)


def test_every_kind_of_character():
    """All assigned characters of the basic planes, each between letters and after a space."""
    chars = [chr(c) for c in range(0x3400) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    texts = ["".join(f"a{c}b {c}1 {c} " for c in chars[i : i + 40]) for i in range(0, len(chars), 40)]
    a, b = ours(texts), library(texts)
    wrong = [t for t, x, y in zip(texts, a[0], b[0], strict=True) if x != y]
    assert not wrong, wrong[:3]
    assert a == b


def test_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    ids, texts = library([r.text or "" for r in docs])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {(r.doc_id, len(i), sha(",".join(map(str, i))), sha(t)) for r, i, t in zip(docs, ids, texts, strict=True)}
    got = bpe.op2_bpe(spark, DATA).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(docs)


def test_nulls_repeats_extra_columns_and_decode(spark):
    rows = [(None, None, 1), (1, "", 2), (1, "same", 3), (1, "same", 3), (2, "long " * 50_000, 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    encoded = bpe.encode(df, PATH)
    assert encoded.columns == ["doc_id", "ids"]
    back = bpe.decode(encoded, PATH).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in back) == sorted((r[0] or 0, r[1] or "") for r in rows)
    assert bpe.encode(df.limit(0), PATH).count() == 0
