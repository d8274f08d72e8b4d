import hashlib
import random
import time
import re

from lexigrove.llm import pii

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def plain(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(EMAIL, text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(CARD, text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(PHONE, text) if 10 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out)


def test_base_against_plain_patterns():
    rng = random.Random(6)
    alphabet = list("ab.@-+ 0123456789()%_é") + ["@a.b", "1.2.3.4", "4111 1111 1111 1111", "+1 (223) 555", "@@", ".."]
    for _ in range(6000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert pii.detect(text) == plain(text), repr(text)
        base, added = pii.find(text)
        assert base == plain(text)


def spans(text):
    base, added = pii.find(text)
    return [(pii.KINDS[k], text[s:e]) for s, k, e in added]


def test_disguises():
    assert spans("write to john.doe [at] example (dot) com now") == [("email", "john.doe [at] example (dot) com")]
    assert spans("write to john at example dot com now") == [("email", "john at example dot com")]
    assert spans("é jοhn@exаmple.com") == [("email", "jοhn@exаmple.com")]
    assert spans("john＠example．org") == [("email", "john＠example．org")]
    assert spans("ab​c@exam​ple.org") == [("email", "ab​c@exam​ple.org")] or pii.find("ab​c@exam​ple.org")[0]
    card = "four one one one one one one one one one one one one one one one"
    assert spans(f"pay {card} today") == [("card", card)]
    assert spans("call plus one five five five two three four five six seven eight") == [("phone", "plus one five five five two three four five six seven eight")]
    assert spans("at ４１１１ １１１１ １１１１ １１１１.") == [("card", "４１１１ １１１１ １１１１ １１１１")]
    assert spans("ip 192[.]168[.]0[.]1 or 10 dot 0 dot 0 dot 1") == [("ip", "192[.]168[.]0[.]1"), ("ip", "10 dot 0 dot 0 dot 1")]
    assert spans("mail a.b1 @ mail.example.com") == [("email", "a.b1 @ mail.example.com")]
    assert spans("mail a.b1 at mail.example.com") == [("email", "a.b1 at mail.example.com")]
    assert spans("mail ab&#64;mail.example.com") == [("email", "ab&#64;mail.example.com")]
    assert spans("mail ab_at_mail_dot_example_dot_com") == [("email", "ab_at_mail_dot_example_dot_com")]
    assert spans("call +1 (9O8) 555-2485") == [("phone", "+1 (9O8) 555-2485")]
    assert spans("to аlice@example.com") == [("email", "аlice@example.com")]
    assert spans("id 411l 1111 1l11 1111 here") == [("card", "411l 1111 1l11 1111")]
    assert spans("host one nine two dot one six eight dot one dot seven up") == [("ip", "one nine two dot one six eight dot one dot seven")]


def test_bare_at_needs_no_other_mark():
    for found in ("john.doe at example.com", "j2smith at example.com", "john.doe-at-example.com", "john.doe_at_example.com", "j2 -at- mail.example.com"):
        assert spans(f"write to {found} now") == [("email", found)]
        assert spans(f"write to {found} now [at] all") == [("email", found)]


def test_made_addresses_are_found_whole():
    rng = random.Random(12)
    names = ["john", "j2", "x_y", "anna+tag", "site", "mail", "example", "a" * 70, "b-c", "q" * 64]
    ats = [" [at] ", "[at]", " (@) ", " at ", "-at-", "_at_", " @ ", " {arroba} ", "<at>", " AT "]
    dots = [" [dot] ", "[.]", " dot ", "(dot)", "_dot_", " -punkt- ", " DOT ", "."]
    for n in range(3000):
        local, domain = [rng.choice(names) for _ in range(rng.randint(1, 12))], [rng.choice(names[:7]).replace("_", "").replace("+", "") for _ in range(rng.randint(1, 14))] + [rng.choice(["com", "org", "de"])]
        at = rng.choice(ats)
        left, right = _spelled(local, rng, dots), _spelled(domain, rng, dots)
        address = left + at + right
        if at.strip(" -_").isalpha() and not re.search(r"[0-9._]", left) and not any(d in left + right for d in dots[:-1]):
            continue
        text = rng.choice(["write to ", "é ", "(", ""]) + address + rng.choice([" now", ", please", "", ". Then go"])
        base, added = pii.find(text)
        found = [text[s:e] for s, k, e in added if k == 0]
        assert found == [address], (text, found)


def _spelled(parts, rng, dots):
    out = parts[0]
    for p in parts[1:]:
        out += rng.choice(dots) + p
    return out


def test_signs_have_no_bound_on_parts():
    assert spans("x.y.z.u.v.w [at] site [dot] com") == [("email", "x.y.z.u.v.w [at] site [dot] com")]
    assert spans("a [at] b.c.d.e.f.g.com.") == [("email", "a [at] b.c.d.e.f.g.com")]
    assert spans("a" * 65 + " [at] site.com") == [("email", "a" * 65 + " [at] site.com")]
    assert spans("john at example dot com dot Then we went") == [("email", "john at example dot com")]
    # Digits without end are no identifier, however they are written.
    assert spans("one " * 90) == [] and spans("1l" * 40) == []
    assert spans("pay " + "one two three " * 40) == []


def test_prose_is_left_alone():
    for text in (
        "look at this dot product of two vectors", "meet at home. Then go on", "one two three four five six seven eight nine",
        "un deux trois, nous irons au bois", "at the house at four", "The point at issue is a dot on the map.",
        "Ouon at er dot the in", "look at example.com for it", "we met @ the house. Then", "at 5 dot the i", "a 40%40 share & more", "x – y", "été à la plage – 12 – 13", "vier fünf sechs sieben acht neun",
    ):
        assert pii.find(text) == ([], []), text


def test_operator(spark):
    rows = [(1, "mail a.b@c.de or 4111111111111111", "x"), (2, None, "x"), (3, "", "x"), (1, "mail a.b@c.de or 4111111111111111", "x"), (4, "1" * 200_000 + "@" * 50_000 + "a" * 200_000, "x"), (5, "1." * 100_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = {r.doc_id: r for r in pii.scan(df).collect()}
    assert out[1].spans == "email:5:13,card:17:33" and out[1].n_email == out[1].n_card == 1
    assert out[1].base_sha256 == hashlib.sha256(out[1].spans.encode()).hexdigest()
    assert out[2].spans == out[3].spans == out[4].spans == "" and out[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert out[5].n_ip == 25_000
    assert pii.scan(df.limit(0)).count() == 0
    assert pii.blank_out("mail a.b@c.de or 4111111111111111.") == "mail [EMAIL] or [CARD]."


def plain_find(text):
    """The added spans with every hit compared with all spans so far."""
    base = pii.detect(text)
    plain = pii._plain_characters(text)
    hits = list(pii.detect(plain.text)) if plain.starts is not None else []
    hits += [*pii._rewritten_signs(plain.text), *pii._rewritten_numbers(plain.text)]
    taken, added = [(s, e) for s, _, e in base], []
    for s, kind, e in sorted(hits, key=lambda h: (h[0], h[1])):
        s, e = plain.source(s, e)
        touched = [(a, b) for a, b in taken if a < e and s < b]
        if all(s <= a and b <= e and e - s > b - a and pii.MARKS.keys().isdisjoint(text[s:a] + text[b:e]) for a, b in touched):
            taken.append((s, e))
            added.append((s, kind, e))
    return base, added


def test_merge_against_all_pairs():
    rng = random.Random(21)
    pieces = [
        "a@b.com ", "\u0430lice@b.org ", "joe at site dot com ", "j.d [at] x (dot) net ", "1.2.3.4 ", "1 dot 2 dot 3 dot 4 ", "+49\xa030 1234 5678 ",
        "four one one one  one one one one  one one one one  one one one one ", "4111 1111 1111 1111 ", "4O12 8888 8888 1881 ", "word ", "\u200b", "x@y", "\uff20z.com ",
    ]
    for _ in range(300):
        text = "".join(rng.choices(pieces, k=rng.randint(1, 14)))
        assert pii.find(text) == plain_find(text), text


def test_signs_are_rewritten_then_detected():
    for text, span in (
        ("mail john.doe at example.com now", "john.doe at example.com"),
        ("mail bob [at] site (dot) co (dot) uk.", "bob [at] site (dot) co (dot) uk"),
        ("j2smith-at-example.com", "j2smith-at-example.com"),
        ("amy @ site dot org", "amy @ site dot org"),
    ):
        base, added = pii.find(text)
        assert [text[s:e] for s, k, e in added if k == 0] == [span]
    assert [k for _, k, _ in pii.find("host 10 dot 20 dot 30 dot 40 up")[1]] == [1]
    assert pii.find("we met at noon dot the rest")[1] == [] and pii.find("10 dot 20 dot 30 dot 400")[1] == []


def test_long_texts_take_linear_time():
    def seconds(n):
        text = "\xa0" + "name%d@site.com " * n % tuple(range(n)) + "bob at site dot org " * n
        start = time.process_time()
        found = pii.find(text)
        assert len(found[0]) == n and len(found[1]) >= n
        return time.process_time() - start

    seconds(500)
    assert seconds(16_000) < 8 * 2.5 * max(0.02, seconds(2000))
