"""Cross-tokenizer alignment against the contract read word by word, with the tokenizers' own libraries."""

import collections
import hashlib

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sievelake.llm import alignment

FILES = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN, P.path("piece_bpe_32k.model"))


def byte_level():
    """The bytes that the characters of a byte-level vocabulary stand for."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@pytest.fixture(scope="module")
def tokens():
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b, table = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), byte_level()

    def both(text):
        if not text:
            return [], []
        xs = [(i, bytes(table[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        ys = [(i, bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        whole = (" " + text).encode()
        return (xs, ys) if b"".join(x for _, x in xs) == whole and b"".join(y for _, y in ys) == whole else ([], [])

    return both


def plain(texts, tokens):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each text, link by link."""
    groups = []
    for text in texts:
        xs, ys = tokens(text)
        ends = [set(), set()]
        for k, side in enumerate((xs, ys)):
            at = 0
            for _, raw in side:
                ends[k].add(at := at + len(raw))
        cuts = sorted(ends[0] & ends[1])
        found = [([], []) for _ in cuts]
        for k, side in enumerate((xs, ys)):
            at = g = 0
            for i, raw in side:
                while at >= cuts[g]:
                    g += 1
                found[g][k].append(i)
                at += len(raw)
        groups.append(found)
    links = [[(a, b) for p, q in g for a in p for b in q] for g in groups]
    count = collections.Counter(pair for found in links for pair in set(found))
    top = collections.Counter()
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for g, found in zip(groups, links, strict=True):
        listed = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in g)
        out.append((sum(len(p) for p, _ in g), sum(len(q) for _, q in g), len(g), len(found), sum(count[x] == top[x[0]] for x in found), sum(count[x] for x in found), hashlib.sha256(listed.encode()).hexdigest() if g else ""))
    return out


TEXTS = [
    "The quick brown fox", None, "", " ", "  two  spaces \n\n and\ttabs\r\n", "日本語 テスト ’tis naïve café", "a ▁ b", "<|endoftext|> </s> <s> <unk> <0x41>", "x" * 3000, "🙂🙃 ẞ İ ſ \x00\x1b\x1c {}", "The quick brown fox",
    "indivisible unbelievably antidisestablishmentarianism 1234567890 3.14159", "ΑΒΓΔ абвгд हिन्दी العربية", "The slow brown dog is quick", "ﬁ ½ Å   　x",
]


@pytest.mark.parametrize("block_bytes", [1, 200, 1_000_000])
def test_alignment_equals_link_by_link(spark, tokens, block_bytes):
    rows = [(None if k == 5 else k % 12, t, "b", "p") for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block string, place string").repartition(3)
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in alignment.digests(df, *FILES, block_bytes=block_bytes).collect()]
    want = [(-1 if r[0] is None else r[0], *x) for r, x in zip(rows, plain(TEXTS, tokens), strict=True)]
    assert sorted(got) == sorted(want)
    assert sum(1 for w in want if w[1]) == len(TEXTS) - 3


def test_alignment_of_documents(spark, tokens):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = df.select("doc_id", "text").collect()
    want = {r.doc_id: x for r, x in zip(rows, plain([r.text for r in rows], tokens), strict=True)}
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in alignment.digests(df, *FILES).collect()}
    assert got == want


def test_alignment_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.digests(none, *FILES).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in alignment.digests(blank, *FILES).collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_vocabulary_map(spark, tokens):
    """The counts that are brought back are those of the whole corpus, over blocks."""
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string").repartition(4)
    found = alignment.vocabulary_map(alignment.aligned(df, *FILES, block_bytes=10)).collect()
    single = {(r.a, r["count"]) for r in found if r.best}
    (the,) = {i for i, raw in tokens("The")[0] if raw == b" The"}
    assert (the, 3) in single
