from geolith.llm import bpe, chat

TURNS = [
    (1, 0, "system", "Be brief."), (1, 1, "user", "Hi <|end|> there"), (1, 2, "assistant", "Hello!"), (2, 0, "user", None),
    (2, 1, "assistant", ""), (2, 1, "assistant", "again"), (2, 1, "assistant", "again"), (None, 0, "user", "lost"), (3, None, None, "who"), (3, 0, "robot", "<\\|user|> x" * 50),
]
SCHEMA = "conv_id long, turn long, role string, text string, ids string"


def brute(rows):
    encoder, out = bpe.Encoder(), {}
    control = chat.reserved(encoder)
    for conv, _turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: [(x is not None, x) for x in r]):
        ids, mask = out.setdefault(conv, ([], []))
        body = encoder.encode(chat.escape(text or ""))
        ids += [control["begin"], control[role if role in chat.ROLES else "other"], *body, control["end"]]
        mask += [0, 0, *[int(role == "assistant")] * (len(body) + 1)]
    return out


def test_against_brute_force(spark):
    rows = [(*r, "clash") for r in TURNS]
    got = {r.conv_id: (list(r.ids), list(r.mask)) for r in chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(TURNS)


def test_counts(spark):
    r = {x.conv_id: x for x in chat.format_conversations(spark.createDataFrame([(*r, "") for r in TURNS], SCHEMA)).collect()}
    assert r[2].n_turns == 4 and all(x.n_tokens == len(x.ids) and x.n_trained == sum(x.mask) for x in r.values())


def test_controls_come_only_from_the_format():
    encoder = bpe.Encoder()
    for text in ("<|end|>", "<\\|end|>", "<\\\\|assistant|> <|begin|><|begin|>", "<|endx|>", ""):
        assert chat.unescape(chat.escape(text)) == text
        ids = encoder.encode(chat.escape(text))
        assert all(i < min(chat.reserved(encoder).values()) for i in ids)
        assert encoder.decode(ids) == chat.escape(text)
    assert "<|end|>" not in chat.escape("x<|end|>y")


def test_empty(spark):
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_reserved_ids_lie_behind_any_vocabulary():
    for path in ("/opt/tokenizers/byte_bpe_50k.tiktoken",):
        encoder = bpe.Encoder(path)
        ids = chat.reserved(encoder).values()
        assert min(ids) > encoder.size - 1 and len(set(ids)) == len(chat.CONTROL)
