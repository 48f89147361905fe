import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from llm import alignment
from llm.queries import QUERIES


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(str(public_tokenizers.path(alignment.TOKENIZER_A)))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(
        model_file=str(public_tokenizers.path(alignment.TOKENIZER_B)))
    return a, b


def byte_values():
    table, extra = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            table[chr(b)] = b
        else:
            table[chr(256 + extra)] = b
            extra += 1
    return table


BYTES = byte_values()


def tokens(tools, text):
    """Ids and byte ends of whole texts by decoded bytes, or None."""
    if not text:
        return None
    a, b = tools
    made = a.encode(" " + text, add_special_tokens=False)
    data_a = [bytes(BYTES[ch] for ch in t) for t in made.tokens]
    ids_b = b.encode(text)
    data_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i)
              else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    raw = (" " + text).encode()
    if b"".join(data_a) != raw or b"".join(data_b) != raw:
        return None
    return (made.ids, data_a), (ids_b, data_b)


def groups(tools, text):
    pair = tokens(tools, text)
    if pair is None:
        return []
    ends = []
    for ids, data in pair:
        at, out = 0, []
        for d in data:
            at += len(d)
            out.append(at)
        ends.append(out)
    common = sorted(set(ends[0]) & set(ends[1]))
    out = []
    for lo, hi in zip([0] + common, common):
        out.append(tuple([i for i, e in zip(ids, end) if lo < e <= hi]
                         for (ids, _), end in zip(pair, ends)))
    return out


def brute(tools, rows):
    made = [groups(tools, t) for _, t in rows]
    links = [[(x, y) for a, b in g for x in a for y in b] for g in made]
    n = Counter(p for one in links for p in set(one))
    top = {}
    for (x, _), k in n.items():
        top[x] = max(k, top.get(x, 0))
    out = []
    for (i, _), g, one in zip(rows, made, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(one),
                    sum(n[p] == top[p[0]] for p in one), sum(n[p] for p in one),
                    hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=repr)


def found(docs, **settings):
    rows = alignment.align(docs, **settings).collect()
    return sorted(((r.doc.doc_id, *r[1:]) for r in rows), key=repr)


ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  ", "a  b", "a \n b", "a　 b", "a 　b",
    "a  b  c", "x  y", "\u0085 z", "a▁b", "a▁ b", " ▁", "tab\tx \t y",
    "日本語 の テキスト", "日本語のテキスト" * 30, "\U0001F600\U0001F601 \U0001F469‍\U0001F680 x",
    "a\x00b \x00 c", "﻿BOM ﻿", "<s> </s> <unk> <0x41> <|endoftext|>", "é ﬁ ① Å Ω",
    "don't we'll I'd 's 're", "1234567890 12 3.14", "!!! ... ?! --- ''' ", "\r\n\r\n x \r", "ñ" * 50,
    "¬ ¬¬ §§ ÿ", "aaaa" * 2000, "the " * 5000, "ab" + " " * 300 + "cd", "​ ​ x",
    "\x1c x \x1f y", "क्षि नमस्ते", "a  b  c", "  o  ", "x   y  z",
]


def made(seed, n):
    rng = random.Random(seed)
    pool = ["the", "of", "ción", "été", "日本", "x1", "\U0001F600", "--", "'s", " ", "Ω", "\t",
            "thon", "enat", "▁", "é", "\x00", "!", "　"]
    for i in range(n):
        yield "".join(rng.choice(pool[:14] if i % 5 else pool) + rng.choice(["", " ", " ", "  ", "\n"])
                      for _ in range(rng.randrange(40)))


# A small memory is forgotten all the time; small chunks make many of them.
@pytest.mark.parametrize("size", [8 << 20, 3000])
def test_equals_whole_texts(spark, tools, size):
    texts = ODD + list(made(1, 300))
    rows = list(enumerate(texts)) + [(None, texts[-1]), (7, texts[-2]), (7, texts[-2])]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows],
                                 "doc_id bigint, text string, pair string, chunk int")
    expected = brute(tools, rows)
    got = found(docs, chunk_bytes=size)
    assert got == expected
    assert sum(r[1] > 0 for r in expected) > 250 and sum(r[1] == 0 for r in expected) > 5


def test_forgetting(monkeypatch, tools):
    monkeypatch.setattr(alignment, "REMEMBERED", 5)
    path = public_tokenizers.path
    tool = alignment.Aligner(str(path(alignment.TOKENIZER_A)), str(path(alignment.TOKENIZER_B)))
    import numpy as np
    for text in made(2, 40):
        if tokens(tools, text) is None:
            continue
        raw = np.frombuffer(text.encode(), np.uint8)
        start, stop, first = tool.cuts(raw, np.array([0, len(raw)]))
        place, number = tool.known(raw, start, stop)
        line = b";".join(tool.text[place[k]] for k in number).decode()
        assert line == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b))
                                for a, b in groups(tools, text))


def test_a_full_memory_keeps_the_frequent_segments(monkeypatch, tools):
    monkeypatch.setattr(alignment, "REMEMBERED", 8)
    path = public_tokenizers.path
    tool = alignment.Aligner(str(path(alignment.TOKENIZER_A)), str(path(alignment.TOKENIZER_B)))
    import numpy as np
    learned, learn = [], tool._learn
    monkeypatch.setattr(tool, "_learn", lambda keys, new: (learned.extend(new), learn(keys, new)))
    for k in range(12):
        text = f"the of and the of and w{2 * k}x w{2 * k + 1}y"
        raw = np.frombuffer(text.encode(), np.uint8)
        place, number = tool.known(raw, *tool.cuts(raw, np.array([0, len(raw)]))[:2])
        assert len(tool.keys) == len(tool.counts) == len(tool.uses) <= 8
        line = b";".join(tool.text[place[k]] for k in number).decode()
        assert line == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b))
                                for a, b in groups(tools, text))
    assert Counter(learned)[b"the"] == 1 and len(learned) == len(set(learned))


def test_links_table(spark, tools):
    rows = list(enumerate(made(3, 60)))
    docs = spark.createDataFrame(rows, "`a.b` bigint, text string")
    n = Counter(p for _, t in rows
                for p in {(x, y) for a, b in groups(tools, t) for x in a for y in b})
    got = alignment.links(alignment.chunked(docs, ["a.b"], chunk_bytes=500)).collect()
    assert {(r.a, r.b): r.n for r in got} == dict(n) and len(got) == len(n)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "doc_id bigint, text string")) == []


def test_query_over_the_whole_table(spark, tools):
    sf = "/root/testdata/sf0.001"
    rows = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op11_alignment"](spark, sf)
    assert got.columns[0] == "doc_id"
    assert sorted(map(tuple, got.collect()), key=repr) == brute(tools, rows)
