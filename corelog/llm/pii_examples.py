"""A small labelled table for the personal-data tagger: sentences of tokens with a label each."""

from __future__ import annotations

import random

LABELS = ("O", "KEY", "EMAIL", "IP", "PHONE", "CARD", "SECRET", "ID")

_SYLLABLES = "an the er in re on ti es or te ed ha nd to it is ar se de la un os ción ment eur ung ich ä ö ü ß é è ñ ó que ge be ver keit".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randrange(1, 5)))


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _hex(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789abcdef") for _ in range(n))


def _mixed(r: random.Random, n: int) -> str:
    return "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))


def _upper(r: random.Random, n: int) -> str:
    return "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "234567" * r.choice((0, 1, 2))) for _ in range(n))


def _plain(r: random.Random) -> list[tuple[str, str]]:
    """What is no personal data but may look like some."""
    k = r.randrange(18)
    y = r.randrange(1900, 2030)
    return [
        (t, "O")
        for t in (
            [str(r.randrange(1, 100))], [str(y)], [f"{r.randrange(10)}.{r.randrange(20)}"], ["version", f"{r.randrange(9)}.{r.randrange(9)}.{r.randrange(99)}"],
            [f"{y}-{r.randrange(1, 13):02}-{r.randrange(1, 29):02}"], [f"{r.randrange(24)}:{r.randrange(60):02}"], [f"{r.randrange(1, 999)},{_digits(r, 3)}.{_digits(r, 2)}"],
            [f"${r.randrange(1, 9999)}"], [f"{r.randrange(100)}%"], [f"{_word(r)}-{_word(r)}"], [f"{_word(r)}/{_word(r)}"], ["and/or"], [f"({_word(r)})"],
            ["CC", "BY-NC", f"{r.randrange(1, 5)}.0."], [f"{r.randrange(1, 32)}/{r.randrange(1, 13)}/{y}"],
            ["pages", f"{k * y % 900}-{k * y % 900 + r.randrange(1, 90)}"], [r.choice(("ISO", "EN", "DIN", "RFC")), f"{r.randrange(100, 19999)}{r.choice(('', '-1', '-2', f':{y}'))}"],
            [f"{r.choice('ABXMZ')}{r.choice('JTSL')}-{r.randrange(10, 999)}", r.choice(("IPv6", "MP3", "H2O", "A4", "2nd", "3rd"))],
        )[k]
    ]


def _private(r: random.Random) -> list[tuple[str, str]]:
    k = r.randrange(16)
    name = _word(r).translate(str.maketrans("äöüßéèñó", "aousseno"))
    host = r.choice(("example.com", "mail.example.org", f"mail{r.randrange(9)}.example.com", "post.example.de", f"{name}.net", "corp.example.co.uk"))
    if k == 0:
        return [(f"{name}@{host}", "EMAIL")]
    if k == 1:
        return [(f"{name}.{r.randrange(100)}@{host}", "EMAIL")]
    if k == 2:
        return [(f"{name.title()}_{_word(r)[:3]}+tag@{host}", "EMAIL")]
    if k == 3:
        return [(".".join(str(r.randrange(1, 256)) for _ in range(4)), "IP")]
    if k == 4:
        return [(":".join(_hex(r, 4) for _ in range(8)), "IP")]
    if k == 5:
        return [(f"+{r.randrange(1, 99)}", "PHONE"), (f"({_digits(r, 3)})", "PHONE"), (f"{_digits(r, 3)}-{_digits(r, 4)}", "PHONE")]
    if k == 6:
        return [(f"({_digits(r, 3)})", "PHONE"), (f"{_digits(r, 3)}-{_digits(r, 4)}", "PHONE")]
    if k == 7:
        return [(r.choice((f"{_digits(r, 3)}-{_digits(r, 3)}-{_digits(r, 4)}", f"+{r.randrange(1, 99)}-{_digits(r, 3)}-{_digits(r, 3)}-{_digits(r, 4)}", f"{_digits(r, 3)}.{_digits(r, 3)}.{_digits(r, 4)}", f"+{_digits(r, 11)}")), "PHONE")]
    if k == 8:
        return [(f"+{r.randrange(1, 99)}", "PHONE"), *[(_digits(r, n), "PHONE") for n in r.choice(((3, 3, 4), (3, 7), (2, 4, 4), (3, 4, 4)))]]
    if k == 9:
        return [(r.choice("3456") + _digits(r, r.choice((14, 15, 15, 15))), "CARD")]
    if k == 10:
        sep = r.choice("- ")
        return [(x, "CARD") for x in sep.join(_digits(r, 4) for _ in range(4)).split(" ")]
    if k == 11:
        return [(r.choice(("AKIA", "ASIA")) + _upper(r, 16), "SECRET")]
    if k == 12:
        word = r.choice(("password", "passwd", "token", "api_key", "secret", "pwd", "apikey"))
        return [(f"{word}{r.choice('=:')}{r.choice((_hex, _mixed))(r, r.choice((10, 16, 18, 24, 40)))}", "SECRET")]
    if k == 13:
        word, q = r.choice(("password", "token", "key", "secret", "api_key")), r.choice(('"', "'", ""))
        return [(word, "KEY"), (r.choice("=:"), "KEY"), (q + r.choice((_hex, _mixed))(r, r.choice((18, 24, 32, 40))) + q, "SECRET")]
    if k == 14:
        return [(r.choice((f"ghp_{_mixed(r, 36)}", f"sk-{_mixed(r, 40)}", f"xoxb-{_digits(r, 11)}-{_mixed(r, 24)}", f"eyJ{_mixed(r, 20)}.{_mixed(r, 30)}.{_mixed(r, 27)}")), "SECRET")]
    return [(r.choice((f"{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}", f"{r.choice(('DE', 'FR', 'ES', 'GB'))}{_digits(r, 20)}")), "ID")]


def examples(n: int = 900, seed: int = 31) -> list[tuple[int, int, str, str]]:
    """(sentence, place, token, label) rows; equal for equal arguments."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        parts: list[tuple[str, str]] = []
        for _ in range(r.randrange(1, 4)):
            parts += [(_styled(r), "O") for _ in range(r.randrange(0, 6))]
            x = r.random()
            if x < 0.55:
                parts += _private(r)
            elif x < 0.85:
                parts += _plain(r)
            elif x < 0.9:
                parts.append((r.choice(("password", "token", "key", "secret", "phone", "email", "card", "ip")), "O"))
        parts += [(_styled(r), "O") for _ in range(r.randrange(0, 5))]
        if parts and r.random() < 0.4:
            parts[-1] = (parts[-1][0] + r.choice(".,;!?"), parts[-1][1])
        rows += [(i, p, t, label) for p, (t, label) in enumerate(parts)]
    return rows


def _styled(r: random.Random) -> str:
    w = _word(r)
    x = r.random()
    w = w.title() if x < 0.15 else (w + _word(r) * (x > 0.19)).upper() if x < 0.21 else w
    return w + (r.choice(",.;:!?") if r.random() < 0.15 else "!!" if r.random() < 0.02 else "")
