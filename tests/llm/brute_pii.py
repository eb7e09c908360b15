"""Surrogates by plain Python, from the same patterns and lists."""

from __future__ import annotations

import hashlib

import regex

from sensorgrid.llm import pii

CARD = regex.compile(pii._CARD)


def number(d, at, below):
    at = at * 5 % 120
    return int(d[at : at + 5], 16) % below


def luhn(digits):
    return sum((int(c) * 2 - 9 * (int(c) > 4) if k % 2 else int(c)) for k, c in enumerate(reversed(digits)))


def mod97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def kind_of(m):
    if "@" in m:
        return "email"
    if regex.match(r"[A-Z]{2}[0-9]{2}", m):
        return "iban"
    if CARD.fullmatch(m):
        return "card"
    if regex.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", m):
        return "ssn"
    if regex.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", m):
        return "ip"
    return "phone" if m[0] in "+(0123456789" else "person" if " " in m else "word"


def parts(m):
    kind = kind_of(m)
    if kind != "person":
        canonical = m.lower() if kind in ("email", "word") else m if kind == "ip" else m.replace(" ", "") if kind == "iban" else regex.sub("[^0-9]", "", m)
        return [(m, kind, canonical, "")]
    tokens, titles = m.split(" "), {w: g for g, ws in pii.TITLES.items() for w in ws.split()}
    given = {w: g for g, ws in pii.GIVEN.items() for w in ws.split()}
    title = titles.get(tokens[0].rstrip("."))
    out = []
    for i, t in enumerate(tokens):
        if i < (title is not None) or t.rstrip(".") in titles:
            out.append((t, None, None, None))
            continue
        script = "cyrillic" if regex.search(r"\p{IsCyrillic}", t) else "greek" if regex.search(r"\p{IsGreek}", t) else "latin"
        role = given.get(t.split("-")[0].capitalize()) or ("s" if i == len(tokens) - 1 and (title or len(tokens) > 1) else title or "n")
        out.append((t, "name", t.lower(), f"{script}_{role}"))
    return out


def surrogate(kind, canonical, role, attempt, key):
    message = f"{kind}\x1f{canonical}\x1f{attempt}"
    d = hashlib.sha512((key + hashlib.sha512((key + message).encode()).hexdigest()).encode()).hexdigest()
    sets = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    drawn = "".join(next((s[number(d, i, len(s))] for s in sets if c in s), c) for i, c in enumerate(canonical))
    n = len(canonical)
    if kind == "email":
        top = regex.search(r"\.[a-z]+$", canonical)[0]
        value = drawn[: n - len(top)] + top
    elif kind == "phone":
        code = max(n - 10, 0)
        value = canonical[:code] + str(number(d, code, 8) + 2) + drawn[code + 1 :]
    elif kind == "card":
        value = canonical[0] + drawn[1:]
        if luhn(canonical) % 10 == 0:
            value = value[:-1] + str(-luhn(value[:-1] + "0") % 10)
    elif kind == "ssn":
        value = drawn
    elif kind == "iban":
        value = canonical[:2] + drawn[2:]
        if mod97(canonical) == 1:
            value = canonical[:2] + f"{98 - mod97(canonical[:2] + '00' + drawn[4:]):02d}" + drawn[4:]
    elif kind == "ip":
        value = ".".join(map(str, (number(d, 0, 223) + 1, number(d, 1, 256), number(d, 2, 256), number(d, 3, 254) + 1)))
    else:
        script, end = role.split("_")
        pick = lambda words, at: words.split()[number(d, at, len(words.split()))]
        k = 2 + attempt // 2
        value = (pick(pii.BEGINNINGS[script], 0) + "".join(pick(pii.MIDDLES[script], 1 + j) for j in range(k)) + pick(pii.ENDINGS[script][end], k + 1)).lower()
    assert attempt <= pii.ROUNDS
    return value


def mapping(entities, key):
    done, pending, attempt = {}, dict(entities), 0
    while pending:
        drawn = {e: surrogate(*e, role, attempt, key) for e, role in pending.items()}
        taken = {*entities, *((k, s) for (k, _), s in done.items())}
        good = {}
        for (kind, canonical), s in sorted(drawn.items()):
            if (kind, s) not in taken and (kind, s) not in {(k, x) for (k, _), x in good.items()} | {(k, x) for (k, c), x in drawn.items() if c < canonical and k == kind}:
                good[kind, canonical] = s
        done |= good
        pending = {e: r for e, r in pending.items() if e not in good}
        attempt += 1
    return done


def rendered(part, told):
    token, kind, _, _ = part
    if kind is None or told is None:
        return token
    if kind == "email":
        return "".join(c.upper() if "A" <= t <= "Z" else c for c, t in zip(told, token, strict=True))
    if kind == "ip":
        return told
    if kind in ("name", "word"):
        return told.upper() if len(token) > 1 and token.upper() == token else told[0].upper() + told[1:]
    rest = iter(told)
    return "".join(next(rest) if regex.match("[A-Z0-9]" if kind == "iban" else "[0-9]", c) else c for c in token)


def replace(texts, key):
    any_, words = regex.compile(pii.ANY), regex.compile(pii.ANY_WORD)
    found = [[parts(m[0]) for m in any_.finditer(t or "")] for t in texts]
    entities = {}
    for doc in found:
        for _, kind, canonical, role in (p for ps in doc for p in ps if p[1]):
            entities[kind, canonical] = min(entities.get((kind, canonical), role), role)
    known, out = mapping(entities, key), []
    for t, doc in zip(texts, found, strict=True):
        mine = {(k, c) for ps in doc for _, k, c, _ in ps if k}
        named = any(ps[0][1] in ("name", None) for ps in doc)

        def new(m, mine=mine):
            told = []
            for p in parts(m[0]):
                e = ("name" if p[1] == "word" else p[1], p[2])
                told.append(rendered(p, known[e] if e in mine else None))
            return " ".join(told)

        out.append(None if t is None else (words if named else any_).sub(new, t))
    return out
