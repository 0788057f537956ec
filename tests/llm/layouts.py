"""Pages written by hand, in layouts and with names that the labeller's training never draws: (html, blocks of the main text)."""

P = [
    "The council voted on Tuesday to reopen the old mill bridge after four years of repairs, ending a detour that had added twenty minutes to the school run.",
    "Engineers replaced two of the five piers, and the deck now carries a separate lane for bicycles, which the original design from 1931 had never allowed for.",
    "Residents who spoke at the meeting were mostly in favour, though several asked who would pay for clearing the snow from the new lane in January.",
    "The mayor said that the budget already covers the winter service, and that the remaining funds will go to lighting on the northern approach.",
    "Work on the lights should begin in May, when the river is low enough for the scaffolding to stand safely on the gravel bank below.",
    "Until then the bridge stays closed at night, and drivers are asked to follow the signs to the motorway crossing further south.",
]
Q = [
    "Mix the flour and salt in a wide bowl, rub in the cold butter with your fingertips, and stop as soon as the crumbs look like coarse sand.",
    "Pour in the milk a little at a time. The dough should just come together; if it sticks to your hands, it has had too much.",
    "Rest it for half an hour in a cool place, then roll it out to the thickness of a finger and cut rounds with a floured glass.",
    "Bake them on the upper shelf until the tops are golden, about fourteen minutes, and eat them the same day with jam.",
]

PAGES = [
    (
        f"""<html><body><div id="xq1"><a href="/">The Valley Post</a> <a href="/n">News</a> <a href="/s">Sport</a> <a href="/w">Weather</a></div>
<div class="zz9"><h1>Mill bridge opens again</h1><p>{P[0]}</p><p>{P[1]}</p><p>{P[2]}</p><p>{P[3]}</p></div>
<div class="kk"><h4>Most read</h4><ol><li><a href="/1">Storm warning lifted for the coast</a></li><li><a href="/2">School choir wins again</a></li><li><a href="/3">Five walks for autumn</a></li></ol></div>
<div class="ff"><a href="/imprint">Imprint</a> <a href="/privacy">Privacy</a> <a href="/jobs">Jobs</a></div></body></html>""",
        ["Mill bridge opens again", *P[:4]],
    ),
    (
        f"""<!doctype html><html><head><title>Scones</title></head><body><table><tr><td><a href=a>Home</a><br><a href=b>Recipes</a><br><a href=c>Shop</a></td>
<td><h2>Plain scones</h2><p>{Q[0]}<p>{Q[1]}<p>{Q[2]}<p>{Q[3]}</td></tr></table><center><a href=x>Contact</a> | <a href=y>Terms</a></center></body></html>""",
        ["Plain scones", *Q],
    ),
    (
        f"""<body><header><div><a href="/">Riverside</a></div><nav><a href="/a">A</a><a href="/b">B</a></nav></header><main><section><h1>Night closures</h1>
<div><div><p>{P[4]}</p></div><div><p>{P[5]}</p></div></div><ul><li>{Q[1]}</li><li>{Q[2]}</li></ul></section></main>
<footer><p>All rights reserved.</p><p><a href="/t">Terms of use</a></p></footer></body>""",
        ["Night closures", P[4], P[5], Q[1], Q[2]],
    ),
    (
        f"""<html><body><div class="a1"><ul><li><a href="#">Start</a></li><li><a href="#">Archive</a></li><li><a href="#">About us</a></li></ul></div>
<div class="b2"><div class="c3"><h1>A bridge for the next century</h1><p>{P[0]}</p><p>{P[1]}</p><blockquote>{P[2]}</blockquote><p>{P[3]}</p></div>
<div class="d4"><h3>Related</h3><a href="#">What the repairs cost</a><a href="#">The mill in old photographs</a><a href="#">Timetable of the works</a></div></div>
<form action="/s"><label>Search the site</label><input name=q><button>Go</button></form></body></html>""",
        ["A bridge for the next century", *P[:4]],
    ),
    (
        f"""<html><body><nav class="gl"><a href="#">One</a><a href="#">Two</a><a href="#">Three</a></nav><article><h1>Scones, again</h1><p>{Q[0]}</p>
<aside><p>Sign up and never miss a recipe. Unsubscribe whenever you like.</p></aside><p>{Q[1]}</p><p>{Q[2]}</p><p>{Q[3]}</p></article>
<section class="thread"><h3>2 replies</h3><div><b>anna</b> <p>Mine came out flat, what did I do wrong?</p></div><div><b>tom</b> <p>Too much milk, I think.</p></div></section></body></html>""",
        ["Scones, again", *Q],
    ),
    (
        f"""<html><body><p><a href="/">index</a> <a href="/up">up</a></p><h1>Notes on the bridge</h1><p>{P[0]}</p><p>{P[1]}</p><h2>Costs</h2><p>{P[3]}</p><p>{P[4]}</p><hr><p><a href="/mail">mail</a> <a href="/rss">rss</a></p></body></html>""",
        ["Notes on the bridge", P[0], P[1], "Costs", P[3], P[4]],
    ),
]


def block_f1(texts: list[str], blocks: list[list[str]]) -> float:
    """F1 of the words of extracted texts against those of the wanted blocks, over all pages."""
    from collections import Counter

    hit = got = want = 0
    for text, own in zip(texts, blocks):
        a, b = Counter(text.split()), Counter(" ".join(own).split())
        hit, got, want = hit + sum((a & b).values()), got + sum(a.values()), want + sum(b.values())
    return 2 * hit / max(1, got + want)
