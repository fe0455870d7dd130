import random

import public_tokenizers
from tokenizers import Tokenizer

from strata.llm.token_counts import Counts, count_tokens, op5_token_counts, prove

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(texts):
    tok = Tokenizer.from_file(PATH)
    return [len(tok.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_proof():
    single = prove(PATH)
    tok = Tokenizer.from_file(PATH)
    assert len(single) > 45_000
    assert all(len(tok.encode(t, add_special_tokens=False).ids) == 1 for t in random.Random(1).sample(sorted(single), 2000))


def test_texts():
    rng = random.Random(4)
    odd = ["I'm 'she'd it's", "a<|endoftext|>b <|endoftext|>", "<|endoftext", "x  y\n\n z \t\r\n", " lead", "trail ", "a\n", "", None, "日本 語", "İstanbul ΣΑΣ", "²½ª ٣", "a b c​d", "x\x1cy\x85z", "🙂!?", "_a_ 12'll", "a" * 3000]
    pool = [*"abc ,.'\n\t é<|>_9", "  ", " \n", "<|endoftext|>", "'s", "ß", "ª", "²", "　", "\x00", "the", " of"]
    odd += ["".join(rng.choice(pool) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    got = list(Counts(PATH, prove(PATH)).of(odd))
    bad = [(t, a, b) for t, a, b in zip(odd, got, library(odd)) if a != b]
    assert not bad, bad[:5]


def test_whole_table(spark, tiny):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op5_token_counts(spark, tiny).collect()}
    want = dict(zip(docs, library(docs.values())))
    assert {i: r.n_tokens for i, r in got.items()} == want
    assert all(r.n_bytes == len(docs[i].encode()) and r.over_limit == (r.n_tokens > 512) for i, r in got.items())


def test_edges(spark):
    rows = [(None, None), (1, ""), (1, "one two"), (1, "one two"), (2, "word " * 60_000)]
    df = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, n_tokens string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in count_tokens(df, PATH).collect()), key=str)
    assert got == sorted(((i, len((t or "").encode()), n) for (i, t), n in zip(rows, library([t for _, t in rows]))), key=str)
    assert count_tokens(df.limit(0), PATH).collect() == []
