"""Chat formatting, the SentencePiece codec and the driver contract."""
import random

import pytest

from stratacohort.llm import chat_format, queries, sentencepiece_codec

TURNS = "conv_id long, turn long, role string, text string, perspective string, part int"


def turns():
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Hello <|im_end|> you"), (1, 3, "cy lon", "x\ny"), (1, 4, "ann", None),
        (2, 5, "ann", "tie b"), (2, 5, "ann", "tie a"), (2, 5, "ann", "tie a"), (2, None, "bob", "first"), (3, 0, "system", "alone"), (4, 1, None, "who"), (4, 2, "ann", ""),
        (None, 1, "ann", "no conversation"), (None, 2, "bob", "é😀"),
    ] + [(9, i, "ann" if i % 2 else "bob", f"turn {i} " + "w" * (i % 50)) for i in range(1500)]
    return [(*r, "clash", 7) for r in rows]


def rendered(rows, me):
    out, masks = "", []
    for _, _, role, text, *_ in rows:
        name = None if role is None else "".join(role).replace(" ", "_")
        head = "assistant" if role == me else "system" if role == "system" else "user" if role is None else f"user name={name}"
        out += f"<|im_start|>{head}\n"
        body = (text or "").replace("<|", "<​|") + "<|im_end|>"
        if role == me:
            masks.append((len(out), len(out) + len(body)))
        out += body + "\n"
    return out, masks


@pytest.mark.parametrize("part_chars", [None, 400])
def test_every_perspective(spark, part_chars):
    """Whole renderings by default, one row each; and in parts."""
    rows = turns()
    options = {"part_chars": part_chars} if part_chars else {}
    got = chat_format.rotate(spark.createDataFrame(rows, TURNS).repartition(3), **options).collect()
    assert part_chars or {r["part"] for r in got} == {0}
    found = {}
    for r in sorted(got, key=lambda r: r["part"]):
        text, masks = found.get((r["conv_id"], r["perspective"]), ("", []))
        assert not part_chars or len(r["text"]) < part_chars + 200
        found[r["conv_id"], r["perspective"]] = (text + r["text"], masks + [(len(text) + m["start"], len(text) + m["end"]) for m in r["masks"]])
    want = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: tuple((x is not None, x or "") if not isinstance(x, int) else (True, x) for x in r[1:4]))
        for me in {r[2] for r in mine} - {None, "system"}:
            want[conv, me] = rendered(mine, me)
    assert found == want and (3, "system") not in found
    assert chat_format.rotate(spark.createDataFrame([], TURNS)).count() == 0


def test_hot_conversations_are_dealt_out(spark):
    """No turn, one turn for all, or turns far apart: ranges stay even, and equal messages are one row."""
    rnd = random.Random(3)
    rows = [(1, turn, rnd.choice(("ann", "bob")), f"{rnd.random()} said") for turn in (None, 7) for _ in range(1500)]
    rows += [(1, 10**9 * i, "ann", f"at {i}") for i in range(1500)] + [(1, 8, "bob", "the same")] * 1500
    schema = "conv_id long, turn long, role string, text string"
    got = {r["perspective"]: r for r in chat_format.rotate(spark.createDataFrame(rows, schema).repartition(5)).collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, *r[2:]))
    for me in ("ann", "bob"):
        text, masks = rendered([(*r, "", 0) for r in order], me)
        assert got[me]["text"] == text and [(m["start"], m["end"]) for m in got[me]["masks"]] == masks and got[me]["n_messages"] == 6000


def test_masks_are_the_assistants_words(spark, sf_dir):
    for r in chat_format.rotate(queries.table(spark, sf_dir, "conversations")).collect():
        assert len(r["masks"]) == r["n_trained"] == r["text"].count("<|im_start|>assistant\n")
        for m in r["masks"]:
            assert r["text"][: m["start"]].endswith("<|im_start|>assistant\n") and r["text"][m["start"] : m["end"]].endswith("<|im_end|>")


@pytest.fixture(scope="module")
def model():
    with open(queries.PIECE_MODEL, "rb") as f:
        return f.read()


def odd_texts():
    rnd = random.Random(5)
    letters = "ab ▁  éß日😀\n\t.,x ​\x00"
    return ["", " ", "  a  b ", "a▁▁b  c", "▁", "<s> </s> <unk> <0x41>", "é ﬁ ①", "�", "word " * 20_000, "x" * 30_000] + ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(800)]


@pytest.mark.parametrize("nul", [False, True])
def test_parity_with_the_library(spark, sf_dir, model, nul):
    """Without NUL characters words are encoded one by one, with one the whole texts of that batch."""
    texts = [r["text"] for r in queries.table(spark, sf_dir, "documents").collect()] + odd_texts()
    assert sentencepiece_codec.parity(model, [t for t in texts if nul or "\x00" not in t]) == []


def test_round_trip(spark, model):
    rows = [(i, t, "clash") for i, t in enumerate(odd_texts())] + [(None, None, "clash"), (1, "same", "clash"), (1, "same", "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    coded = sentencepiece_codec.encode(df, queries.PIECE_MODEL)
    assert coded.columns == ["doc_id", "text", "ids", "n_tokens", "round_trip"]
    got = sentencepiece_codec.decode(coded, queries.PIECE_MODEL).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["text"] is None:
            assert r["ids"] is r["n_tokens"] is r["decoded"] is r["round_trip"] is None
        else:  # this model's normaliser only marks spaces
            assert r["round_trip"] and r["decoded"] == r["text"].replace("▁", " ") and r["n_tokens"] == len(r["ids"])
    assert sentencepiece_codec.encode(df.limit(0), queries.PIECE_MODEL).count() == 0
    with pytest.raises(Exception, match="outside the vocabulary"):
        sentencepiece_codec.decode(spark.createDataFrame([([32_000],)], "ids array<int>"), queries.PIECE_MODEL).collect()


def message(*fields):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for number, value in fields:
        out += varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | (5 if isinstance(value, float) else 2)) + (__import__("struct").pack("<f", value) if isinstance(value, float) else varint(len(value)) + value)
    return out


def test_a_unigram_model_by_hand():
    """A small model, written as a protobuf: scores decide the cut, bytes stand in for what is unknown, spaces are squeezed."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", -9.0, 6) for i in range(256)] + [("▁", -3.0, 1), ("a", -4.0, 1), ("b", -4.0, 1), ("ab", -2.0, 1), ("▁a", -2.5, 1), ("▁ab", -6.0, 1)]
    data = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces) + message((2, message((3, 1), (35, 1)))) + message((3, message((3, 1), (4, 1), (5, 1))))
    m = sentencepiece_codec.parse_model(data)
    assert m["type"] == sentencepiece_codec.UNIGRAM and m["byte_fallback"] and m["strip_extra"] and len(m["pieces"]) == 265
    texts = ["ab", "  ab   ba ", "a", "é", "", "aab b"]
    assert sentencepiece_codec.parity(data, texts) == []
    codec = sentencepiece_codec.Codec(data)
    ids, ends, right = codec.encode(texts)
    assert codec.decode(ids, ends) == ["ab", "ab ba", "a", "é", "", "aab b"] and right.all()


def test_a_large_unigram_model(spark, sf_dir, model):
    """32,000 pieces whose scores fall with their rank: the best cut by scores, as the library finds it, over whole documents."""
    import math

    known = sentencepiece_codec.parse_model(model)["pieces"]
    pieces = [(p, -1.5 * math.log(i + 2) - 1e-4 * (i * 7919 % 1009) if kind == sentencepiece_codec.NORMAL else -25.0 * (kind == sentencepiece_codec.BYTE), kind) for i, (p, _, kind) in enumerate(known)]
    data = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces) + message((2, message((3, 1), (35, 1)))) + message((3, message((3, 1), (4, 1), (5, 1))))
    texts = [r["text"] for r in queries.table(spark, sf_dir, "documents").collect() if r["text"]] + ["", "  x  y ", "日本 é 😀", "a" * 300]
    import sentencepiece

    other, codec = sentencepiece.SentencePieceProcessor(model_proto=data), sentencepiece_codec.Codec(data)
    differ = sentencepiece_codec.parity(data, texts)
    assert len(differ) <= 2  # the library adds scores up as 32-bit floats: of two cuts that are equal to six places it may take the other
    for text in differ:
        ids, ends, _ = codec.encode([text])
        assert abs(sum(pieces[i][1] for i in ids) - sum(pieces[i][1] for i in other.encode(text))) < 1e-3
    ids, ends, right = codec.encode(texts[:20])
    assert right.all() and codec.decode(ids, ends) == [" ".join(t.split(" ")).strip() if "  " not in t else x for t, x in zip(texts[:20], codec.decode(ids, ends))]


def test_entry_without_the_folder(tmp_path):
    """The driver contract holds when the corpus operators are not there."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "stratacohort", tmp_path / "stratacohort", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline_e2e' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op')]; print(len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert said.returncode == 0, said.stderr
