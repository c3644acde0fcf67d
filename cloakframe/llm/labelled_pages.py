"""Labelled pages from which the content model learns.

Each page is put together from a hand-written inventory: containers of main text, and parts of a
page that are not main text, with the tags and names that sites give them. ``main`` marks the
elements that hold the main text, ``not`` what inside them does not belong to it. The words are
filler; what counts is markup, lengths and links.
"""

from __future__ import annotations

import random

SENTENCES = [
    "The river rose again this week, and people along the bank began to move what they could.",
    "Nobody had expected rain of that kind so late, the mayor said.",
    "It ended.",
    "Older residents remembered a spring like this one, when the lower streets stood under water for days and boats were tied to lamp posts.",
    "Is that likely to change?",
    "By noon the bridge was closed.",
]
MAIN = [
    '<article main>{}</article>',
    '<main main><article>{}</article></main>',
    '<div class="wrapper"><main main id="main">{}</main></div>',
    '<div main class="entry-content">{}</div>',
    '<div id="content"><div main class="article-body">{}</div></div>',
    '<div main class="post"><div class="post-content">{}</div></div>',
    '<div class="container"><div main class="story text">{}</div></div>',
    '<div main role="main" class="page-content"><section>{}</section></div>',
    '<div class="page"><section main class="content body">{}</section></div>',
    '<div class="wrap"><div main class="main-text">{}</div></div>',
    '<div main id="article"><div>{}</div></div>',
    '<div class="row"><div main class="col">{}</div></div>',
]
#: Kind of part: how it may be written, and whether it may stand inside the main container.
PARTS = {
    "menu": (
        ['<nav{n}><ul>{l}</ul></nav>', '<div class="nav menu"{n}><ul>{l}</ul></div>', '<ul class="navbar menu"{n}>{l}</ul>',
         '<div id="navigation"{n}>{l}</div>', '<nav class="breadcrumb"{n}>{l}</nav>', '<div class="breadcrumbs"{n}>{l}</div>',
         '<div class="pagination pager"{n}>{l}</div>', '<div class="tags"{n}>{l}</div>', '<div class="toolbar topbar"{n}>{l}</div>'],
        True,
    ),
    "header": (
        ['<header><h1>Daily Paper</h1><p>{t}</p></header>', '<div id="header" class="header"><p>{t}</p></div>',
         '<header class="site-header masthead" role="banner"><p>{t}</p>{l}</header>', '<div class="masthead"><div>{t}</div></div>'],
        False,
    ),
    "footer": (
        ['<footer><p>{t}</p></footer>', '<footer class="site-footer" role="contentinfo">&copy; 2020 {t}</footer>',
         '<div id="footer" class="footer"><p>Copyright 2020. {t}</p></div>', '<div class="legal copyright"><p>All rights reserved. {t}</p></div>',
         '<footer>&copy; site &middot; {t}</footer>', '<div class="bottom footer"><ul>{l}</ul></div>'],
        False,
    ),
    "sidebar": (
        ['<aside{n}><p>{t}</p></aside>', '<aside class="sidebar"{n}><h3>Popular</h3><ul>{l}</ul><p>{t}</p></aside>',
         '<div id="sidebar" class="sidebar widget"{n}><p>{t}</p></div>', '<div class="side rail widget"{n}><h4>Latest</h4><p>{t}</p></div>',
         '<div class="related"{n}><h3>Related</h3><p>{t}</p><ul>{l}</ul></div>', '<div class="recommended more"{n}><p>{t}</p></div>',
         '<div class="author bio"{n}><p>{t}</p></div>'],
        True,
    ),
    "notice": (
        ['<div class="notice"{n}><p>{t}</p></div>', '<div class="cookie consent" role="dialog"{n}><p>We use cookies. {t}</p></div>',
         '<div id="cookies" class="cookie-banner"{n}>{t}</div>', '<div class="alert warning" role="alert"{n}><p>{t}</p></div>',
         '<div class="popup modal overlay"{n}><p>{t}</p></div>', '<section class="notification notice"{n}>{t}</section>',
         '<div class="disclaimer privacy gdpr"{n}><p>{t}</p></div>'],
        True,
    ),
    "advert": (
        ['<div class="ad"{n}>{t}</div>', '<div class="ads"{n}><p>{t}</p></div>', '<div class="advert"{n}><p>{t}</p></div>',
         '<div class="advertisement banner"{n}>{t}</div>', '<aside class="ad promo"{n}><p>{t}</p></aside>',
         '<div class="sponsored sponsor"{n}><p>{t}</p></div>', '<div class="promo promotion"{n}><h4>Buy now</h4><p>{t}</p></div>',
         '<section id="ad" class="adbox"{n}>{t}</section>'],
        True,
    ),
    "form": (
        ['<form{n}><p>{t}</p><label>Mail</label></form>', '<form class="search" role="search"{n}><label>Search</label></form>',
         '<div class="newsletter subscribe"{n}><p>{t}</p><form><label>Mail</label></form></div>',
         '<div class="login signup"{n}><form><p>{t}</p></form></div>', '<form class="contact" action="/s"{n}><fieldset><legend>{t}</legend></fieldset></form>'],
        True,
    ),
    "share": (['<div class="share social"{n}><p>{t}</p>{l}</div>', '<ul class="sharing social"{n}>{l}</ul>'], True),
    "comments": (
        ['<section class="comments" id="comments"{n}><h2>Comments</h2><article class="comment"><p>{t}</p></article></section>',
         '<div class="comments"{n}><div class="comment"><p>{t}</p></div><div class="comment reply"><p>{t}</p></div></div>',
         '<div id="comments"{n}><h3>2 comments</h3><p>{t}</p><p>{t}</p></div>',
         '<ol class="comment-list comments"{n}><li class="comment"><p>{t}</p></li><li>{t}</li></ol>',
         '<div class="reader-comments discussion"{n}><p>{t}</p></div>', '<section class="responses replies"{n}><h2>Responses</h2><p>{t}</p></section>',
         '<div id="disqus_thread" class="disqus"{n}><p>{t}</p></div>', '<div class="feedback reviews"{n}><div class="comment-body"><p>{t}</p></div></div>',
         '<section class="user-comments"{n}><blockquote>{t}</blockquote><p>{t}</p></section>'],
        True,
    ),
}


def _text(rng: random.Random) -> str:
    return " ".join(rng.choice(SENTENCES) for _ in range(rng.randint(1, 5)))


def _links(rng: random.Random) -> str:
    words = rng.sample(["home", "news", "sport", "about", "contact", "archive", "water"], rng.randint(2, 6))
    return "".join(f'<li><a href="/{w}">{w.title()}</a></li>' for w in words)


def _part(rng: random.Random, kind: str, inside: bool) -> str:
    form = rng.choice(PARTS[kind][0]).replace("{n}", " not" if inside else "")
    while "{t}" in form:
        form = form.replace("{t}", _text(rng), 1)
    return form.replace("{l}", _links(rng))


def _main(rng: random.Random) -> str:
    body = [f"<h1>{rng.choice(SENTENCES)}</h1>" if rng.random() < 0.5 else "<h1>Water rises in town</h1>"]
    kinds = ["<p>{}</p>"] * 6 + [
        "<h2>{}</h2>", "<h2>Later that day</h2>", "<blockquote>{}</blockquote>", "<ul><li>{}</li><li>{}</li></ul>",
        "<ol><li>{}</li></ol>", "<pre>{}</pre>", "<table><tr><td>Level</td><td>{}</td></tr></table>", "<div>{}</div>",
        "<section><h3>Night</h3><p>{}</p></section>", "<figure><figcaption>{}</figcaption></figure>",
        "<dl><dt>Where</dt><dd>{}</dd></dl>", '<p>{} <a href="/x">a link</a> in it.</p>', "<p><b>{}</b></p>",
    ]
    for _ in range(rng.randint(2, 9)):
        form = rng.choice(kinds)
        body.append(form.format(*(_text(rng) for _ in range(form.count("{}")))))
    for kind in PARTS:
        if PARTS[kind][1] and rng.random() < 0.2:
            body.insert(rng.randint(1, len(body)), _part(rng, kind, True))
    return rng.choice(MAIN).format("".join(body))


def pages(n: int = 300, seed: int = 7) -> list[str]:
    """n labelled pages, the same each time."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        kinds = [k for k in PARTS if rng.random() < 0.5]
        split = rng.randint(0, len(kinds))
        before, after = kinds[:split], kinds[split:]
        if "comments" in before:
            before.remove("comments")
            after.append("comments")
        body = [_part(rng, k, False) for k in before] + [_main(rng)] + [_part(rng, k, False) for k in after]
        out.append(f"<html><body>{''.join(body)}</body></html>")
    return out
