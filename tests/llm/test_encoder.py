"""The remembering encoder against the library on whole texts."""

import random

import pytest

from scorenet.llm.text_units import MemoEncoder

P = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_same_ids(name):
    import numpy as np

    enc = MemoEncoder(open(P.path(name), "rb").read(), most=200)
    rng = random.Random(5)
    atoms = ["the", "Thtion", "don't", "x1", "é", "Ñandú", "ΑΣ", "!!", "a" * 90, " ", "　", "\x1c", "\x01", "\x02", "<|endoftext|>", "́", "日本", "\U0001f600", "▁", "'s", "12345"]
    spaces = [" ", " ", " ", " ", "\n", "\n", "  ", " \n", "\n ", "\n\n", "\t", "\r\n", "\x0b", ""]
    texts = ["", None, " ", "\n", "a ", " a", "a\n", "\na", "a  b", "a\n\nb"]
    for k in range(1500):
        n = rng.randrange(1, 12)
        sp = spaces[:6] if k % 2 else spaces
        texts.append("".join(rng.choice(atoms[:9] if k % 3 else atoms) + rng.choice(sp) for _ in range(n)).strip() if k % 5 else "".join(rng.choice(atoms + spaces) for _ in range(n)))
    texts += [f"{chr(c)}x{chr(c)} W{chr(c)}" for c in range(0x21, 0x180)]
    got = [list(np.frombuffer(b, "<u4")) for lo in range(0, len(texts), 50) for b in enc.encode_all(texts[lo : lo + 50])]
    assert got == [enc.tok.encode(t or "", add_special_tokens=False).ids for t in texts]
