"""Two tokenizers over the same texts against a token by token comparison."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from datalumen.llm import alignment
from tokenizers import Tokenizer

PATHS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
SCHEMA = "doc_id bigint, text string, pair string, n string, row string, one string"


def texts():
    rng = random.Random(8)
    alphabet = ["a", "ée", "straße ", "the", " of", "  ", "\n", "\t ", "'s", "'Re", "12", "3.5", "%$", "日本", "语", "Ω", "😀", " ", " ", "ǅ", "İ", "_", "ñ"]
    out = [None, "", " ", "  ", "a", "<|endoftext|>", "x <s> </s> <0x41> <unk>", "bad ▁ sign", "\x00", "a\x00b", "tail  ", "\n\n", "é", "ﬁ １"]
    out += ["".join(rng.choices(alphabet, k=rng.choice([1, 4, 30]))) for _ in range(150)]
    out += ["".join(chr(rng.randrange(1, 0x250)) for _ in range(40)) for _ in range(60)]
    return out + [out[20], out[20], "the quick brown fox. " * 4000, "=" * 5000]


def rows():
    return [(i if i % 9 else None, t, "x", "y", "z", "w") for i, t in enumerate(texts())]


def expected():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[2])
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(x): x for x in shown} | {chr(0x100 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    held, counts = [], Counter()
    for doc, text, *_ in rows():
        one = a.encode(" " + (text or ""), add_special_tokens=False) if text else None
        left = [(i, bytes(byte[c] for c in t)) for i, t in zip(one.ids, one.tokens)] if text else []
        right = []
        for i in b.encode(text) if text else []:
            piece = b.id_to_piece(i)
            right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = b" " + (text or "").encode()
        if not text or any(b"".join(x for _, x in side) != whole for side in (left, right)):
            held.append((doc, 0, 0, 0, "", Counter()))
            continue
        spans = []
        for side in (left, right):
            at, out = 0, []
            for i, x in side:
                out.append((at, at + len(x), i))
                at += len(x)
            spans.append(out)
        links, k = Counter(), 0
        for s, e, i in spans[0]:
            while k and spans[1][k - 1][1] > s:
                k -= 1
            while k < len(spans[1]) and spans[1][k][0] < e:
                if spans[1][k][1] > s:
                    links[i, spans[1][k][2]] += 1
                k += 1
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, low = [], 0
        places = [0, 0]
        for cut in cuts:
            parts = []
            for k, side in enumerate(spans):
                ids = []
                while places[k] < len(side) and side[places[k]][1] <= cut:
                    ids.append(str(side[places[k]][2]))
                    places[k] += 1
                parts.append(",".join(ids))
            groups.append("|".join(parts))
            low = cut
        counts.update(set(links))
        held.append((doc, len(left), len(right), len(cuts), hashlib.sha256(";".join(groups).encode()).hexdigest(), links))
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    return Counter((doc, n_a, n_b, n_groups, sum(links.values()), digest, sum(n for p, n in links.items() if counts[p] == best[p[0]]),
                    sum(n * counts[p] for p, n in links.items())) for doc, n_a, n_b, n_groups, digest, links in held)


@pytest.mark.parametrize("broadcast", [alignment.BROADCAST, 10])
def test_alignment(spark, broadcast):
    table = spark.createDataFrame(rows(), SCHEMA).repartition(6)
    found = alignment.cross_tokenizer(table, *PATHS, broadcast=broadcast)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    got, want = Counter(tuple(r) for r in found.select(*names).collect()), expected()
    assert got == want
    assert sum(n for r, n in want.items() if not r[1]) >= 3


def test_nothing_to_align(spark):
    assert alignment.cross_tokenizer(spark.createDataFrame([], SCHEMA), *PATHS).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert {tuple(r)[1:] for r in alignment.cross_tokenizer(blank, *PATHS).collect()} == {(0, 0, 0, 0, "", 0, 0)}
