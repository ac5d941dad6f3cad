"""Main text of pages: a plain twin of the scoring, labelled pages, names that are no verdicts, and deep nesting."""

import math
import random
import re
import resource
import time
from collections import defaultdict

import pytest

from kinweave.llm import html_text


# --- a twin of the scoring over whole paths -----------------------------------


def brute_content(blocks):
    """``blocks``: ``(path, zone, names, never, article, text, linked)`` with paths and names as tuples; names are ``(path, soft)`` from the outside in."""
    live = [b for b in blocks if not b[3]]
    stops = lambda t: sum(t.count(c) for c in ".!?…。")
    plain_article = any(b[4] and not b[2] for b in live)

    def overruled(name, soft):
        for inside in (True, False):
            own = [b for b in live if b[2] and b[2][-1][0] == name and b[4] == inside]
            text, links = sum(len(b[5]) - b[6] for b in own), sum(b[6] for b in own)
            every = sum(len(b[5]) - b[6] for b in live if b[4] == inside)
            if soft and (inside or not plain_article) and text >= 400 and text >= 0.7 * every and sum(stops(b[5]) for b in own) >= 4 and links <= 0.2 * (text + links):
                return True
        return False

    def weight(names):
        return 1.0 if all(overruled(*n) for n in names) else 0.02

    score = []
    for path, _, _, never, _, _, _ in blocks:
        same = [b for b in live if b[0] == path]
        if never:
            score.append(0.0)
            continue
        chars, marks, linked = sum(len(b[5]) for b in same), sum(len(re.findall(r"[.,;:!?…。，、]", b[5])) for b in same), sum(b[6] for b in same)
        score.append(math.log1p(chars / len(same)) * (1 + math.log1p(marks / len(same))) * max(1 - linked / chars, 0.02))
    held = {side: sum(len(b[5]) - b[6] for b in live if b[4] == side and weight(b[2]) == 1) for side in (True, False)}
    marked = held[True] > 0 and held[True] >= 0.25 * (held[True] + held[False])
    zones = defaultdict(list)
    for k, b in enumerate(blocks):
        if not b[3]:
            near = [(score[j], math.exp(-((j - k) ** 2) / 2)) for j in range(max(0, k - 2), min(len(blocks), k + 3))]
            mean = sum(s * w for s, w in near) / sum(w for _, w in near)
            zones[b[1]].append((mean * weight(b[2]) * (0.05 if marked and not b[4] else 1), len(b[5])))
    pooled = {z: sum(s * n for s, n in v) / sum(n for _, n in v) for z, v in zones.items()}
    least = 0.3 * max([2.0, *pooled.values()])
    return [not b[3] and pooled[b[1]] >= least - 1e-12 for b in blocks]


def test_content_against_whole_paths():
    rng = random.Random(5)
    kept = dropped = 0
    for _ in range(400):
        page, plain, numbers, named, zones = html_text.Page(), [], {(): 0}, {}, {}
        paths = [tuple(rng.choice("abc") for _ in range(rng.randrange(1, 4))) for _ in range(6)]
        for path in sorted({p[:k] for p in paths for k in range(1, 4)}, key=len):
            numbers[path] = len(numbers)
            outer = named.get(path[:-1], ())
            own = rng.random() < 0.2
            named[path] = (*outer, (path, rng.random() < 0.7)) if own else outer
            zones[path] = path if own or rng.random() < 0.5 else zones.get(path[:-1], ())
            if own:
                page.around[numbers[path]] = (numbers[outer[-1][0]] if outer else 0, named[path][-1][1])
        article = {p: p[0] == "a" and rng.random() < 0.9 for p in paths}
        for _ in range(rng.randrange(1, 14)):
            path = rng.choice(paths)
            text = "".join(rng.choice(("word ", "and, ", "end. ")) for _ in range(rng.choice((1, 3, 10, 120)))).strip()
            linked, never = rng.choice((0, 0, len(text) // 2, len(text))), rng.random() < 0.1
            names = named[path]
            page.blocks.append(html_text.Block(numbers[path], numbers[zones[path]], numbers[names[-1][0]] if names else 0, never, article[path], text, linked))
            plain.append((path, zones[path], names, never, article[path], text, linked))
        got = html_text.content_blocks(page)
        assert got == brute_content(plain)
        kept, dropped = kept + sum(got), dropped + len(got) - sum(got)
    assert kept > 300 and dropped > 300


# --- pages with known text ----------------------------------------------------


def sentence(rng, n=None):
    words = ["".join(rng.choice(("an", "the", "in", "er", "ou", "st")) for _ in range(rng.randrange(1, 4))) for _ in range(n or rng.randrange(6, 25))]
    return " ".join(words).capitalize() + rng.choice((".", ".", "!", ", so.")) + ""


def labelled_page(rng):
    """A page of one of several layouts, and its main text."""
    links = "".join(f"<li><a href='/{k}'>{sentence(rng, 1)}</a></li>" for k in range(rng.randrange(4, 12)))
    furniture = [
        f"<div class='{rng.choice(('nav', 'main-nav', 'menu', 'site-menu'))}'><ul>{links}</ul></div>",
        f"<nav><ul>{links}</ul></nav>",
        f"<div id='{rng.choice(('sidebar', 'left-sidebar', 'related-posts'))}'><p>{sentence(rng)}</p><ul>{links}</ul></div>",
        f"<div class='{rng.choice(('cookie-notice', 'consent', 'ad', 'ad-box', 'share-buttons', 'newsletter'))}'>{sentence(rng)}</div>",
        f"<div class='{rng.choice(('comments', 'user-comments', 'comment-list'))}'>" + "".join(f"<div class=comment><p>{sentence(rng)}</p></div>" for _ in range(rng.randrange(1, 6))) + "</div>",
        f"<footer><p>{sentence(rng)} &copy;</p></footer>",
        "<script>if (a < b) '</p>'</script>",
        f"<form><label>{sentence(rng, 3)}</label><input></form>",
    ]
    rng.shuffle(furniture)
    body = [sentence(rng, 6), *(" ".join(sentence(rng) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(3, 12)))]
    inner = f"<h1>{body[0]}</h1>" + "".join(f"<p>{p}</p>" for p in body[1:])
    if rng.random() < 0.3:
        at = inner.index("</p>") + 4
        inner = inner[:at] + f"<div class=share-buttons>{sentence(rng, 4)}</div>" + inner[at:]
    wrapped = rng.choice(
        (
            f"<article>{inner}</article>", f"<main>{inner}</main>", f"<div class='post social-science'>{inner}</div>", f"<div class=main-top><div class=story>{inner}</div></div>",
            f"<article><div class=side-effects>{inner}</div></article>", f"<div role=main>{inner}</div>", f"<article class=promo-tour><section class=notices-of-appeal>{inner}</section></article>",
        )
    )
    cut = rng.randrange(len(furniture))
    return f"<!DOCTYPE html><html><head><title>{body[0]}</title></head><body>{''.join(furniture[:cut])}{wrapped}{''.join(furniture[cut:])}</body></html>", body


def test_text_of_labelled_pages():
    rng = random.Random(9)
    right = said = wanted = 0
    for _ in range(300):
        page, body = labelled_page(rng)
        got = html_text.main_text(page).split("\n")
        right += sum(len(x) for x in got if x in body)
        said += sum(map(len, got))
        wanted += sum(map(len, body))
    assert right >= 0.999 * said and right >= 0.999 * wanted


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<body><div class='post social-science'><h1>T</h1><p>Long article text, with stops. And more.</p></div>", "T\nLong article text, with stops. And more."),
        ("<body><div class=main-top><p>Long article text, with stops. And more.</p></div>", "Long article text, with stops. And more."),
        ("<main><div class=share-price-story><p>Prices rose, again. And more.</p></div></main>", "Prices rose, again. And more."),
        ("<article><p>Lead.</p><div class=side-effects><p>More, of it.</p></div></article>", "Lead.\nMore, of it."),
        ("<article><p>Lead.</p><section class=notices-of-appeal><p>More, of it.</p></section></article>", "Lead.\nMore, of it."),
        ("<body><div class=nav><a href=x>Home</a></div><div class=social>" + "<p>Running text, of an article. With stops.</p>" * 20 + "</div>", "\n".join(["Running text, of an article. With stops."] * 20)),
        ("<article><p>Short one.</p></article><div class=related>" + "<p>Running text, of another article. With stops.</p>" * 20 + "</div>", "Short one."),
        ("<article><p>Short one.</p></article><div class=comments>" + "<p>Running text, of readers. With stops.</p>" * 20 + "</div>", "Short one."),
        ("<body><div class=ad>Buy, now.</div>", ""),
        ("<div><article class=card><p>Teaser.</p></article></div><div class=body>" + "<p>Running text, of an article. With stops.</p>" * 20 + "</div>", "\n".join(["Running text, of an article. With stops."] * 20)),
    ],
)
def test_names_are_weighed(page, want):
    got = html_text.main_text(page)
    assert got == want or got == "Teaser.\n" + want


@pytest.mark.parametrize(("unit", "times", "seconds"), [("<div>x", 8_000, 1.0), ("<div>x", 170_000, 20.0), ("<div class=ad>x", 20_000, 5.0), ("<a '>x", 100_001, 10.0)])
def test_time_is_in_proportion_to_the_page(unit, times, seconds):
    began = time.process_time()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    html_text.main_text(unit * times + "</i></p></x>" * 1000)
    assert time.process_time() - began < seconds
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600_000


def test_unclosed_quotes_end_no_page():
    assert html_text.main_text("<p>one, two.</p><a title='x>three<p>four, five.</p>").endswith("four, five.")
    assert html_text.main_text("<p title='a > b'>quoted</p>") == "quoted"
