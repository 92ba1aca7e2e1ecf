"""Card numbers that the base pattern joins with their neighbours."""

import random

from tessera.llm import pii


def test_adjacent_cards_are_added():
    crf = pii.train(pii.labelled_rows())
    rng = random.Random(7)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    card = lambda k, valid: next(x for x in iter(lambda: digits(k), None) if pii.luhn(x) == valid)
    texts, gold = [], []
    for i in range(300):
        head, parts, spans = f"berco {digits(3)} " if i % 3 == 0 else "berco menla ", [], []
        for k in range(2):
            n = card(16, i % 2 == 0)
            parts.append(n if i % 5 else " ".join(n[j : j + 4] for j in range(0, 16, 4)))
        text = head
        for n in parts:
            spans.append(("card", len(text), len(text) + len(n)))
            text += n + " "
        texts.append(text + "tor wana.")
        gold.append(spans if i % 2 == 0 else [])
    bases, every = pii.all_spans(crf, texts)
    added = [set(e) - set(b) for b, e in zip(bases, every, strict=True)]
    want = sum(map(len, gold))
    assert sum(len(a & set(g)) for a, g in zip(added, gold, strict=True)) >= 0.9 * want
    wrong = sum(len(a - set(g)) for a, g in zip(added, gold, strict=True))
    assert wrong <= 0.05 * want


def test_cards_of_the_test_documents():
    crf = pii.train(pii.labelled_rows())
    for pair in ("7536784127813050 4845168114407329", "2353820953013749 4550997810720808"):
        text = f"sen tor {pair} wana lo"
        bases, every = pii.all_spans(crf, [text])
        want = [("card", text.index(n), text.index(n) + 16) for n in pair.split() if pii.luhn(n)]
        assert want and bases == [[]] and every == [want]
