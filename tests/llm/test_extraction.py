"""The block labeller on page layouts that are written here and that its training has not seen."""

from __future__ import annotations

import random

import numpy as np

from gleanline.llm import op7_extraction as op

WORDS = "the of river stone market light under seven winter letter garden children music quiet engine harbour travelled slowly because nobody remembered old bridge morning paper answered window mountain".split()
LINKS = ["Home", "About us", "Contact", "News", "Sport", "Log in", "Sign up", "Archive", "Terms", "Privacy"]


def sentence(rng, n=None):
    w = [rng.choice(WORDS) for _ in range(n or rng.randrange(8, 22))]
    return " ".join(w).capitalize() + rng.choice(".." "!?")


def article(rng):
    return [sentence(rng, 6).rstrip(".!?")] + [" ".join(sentence(rng) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(3, 9))]


def links(rng, tag="li"):
    return "".join(f"<{tag}><a href='/x{k}'>{x}</a></{tag}>" for k, x in enumerate(rng.sample(LINKS, rng.randrange(4, 9))))


def table_page(rng, body):
    paras = "".join(f"<p>{x}</p>" for x in body[1:])
    return f"<html><body><table width=100%><tr><td colspan=2><b>My Site</b> | <a href=/>start</a></td></tr><tr><td valign=top>{links(rng, 'div')}</td><td><h2>{body[0]}</h2>{paras}</td></tr><tr><td colspan=2><font size=1>&copy; 2019 My Site. All rights reserved.</font></td></tr></table></body></html>"


def blog_page(rng, body):
    paras = "".join(f"<p>{x}</p>" for x in body[1:])
    comments = "".join(f"<li class=comment><cite>user{k} says:</cite><p>{sentence(rng)}</p></li>" for k in range(rng.randrange(1, 5)))
    return f"<body><div id=page><div id=masthead><h1><a href=/>A Blog</a></h1><ul id=menu>{links(rng)}</ul></div><div id=primary><div class=post><h2>{body[0]}</h2><div class=entry>{paras}</div></div><ol class=commentlist>{comments}</ol><form id=respond><label>Leave a reply</label><textarea></textarea></form></div><div id=secondary><h3>Recent posts</h3><ul>{links(rng)}</ul></div><div id=colophon>Powered by a blog engine</div></div></body>"


def news_page(rng, body):
    paras = "".join(f"<p>{x}</p>" + ("<div class='ad-slot'>Advertisement</div>" if rng.random() < 0.2 else "") for x in body[1:])
    return f"<body><div class='cookie-banner'><p>We use cookies to improve your experience.</p><button>Accept</button></div><header><nav><ul>{links(rng)}</ul></nav></header><main><article><h1>{body[0]}</h1>{paras}</article><aside><h4>Most read</h4><ul>{links(rng)}</ul></aside></main><footer><p>Copyright 2024 The Paper Ltd</p><ul>{links(rng)}</ul></footer><script>for(i=0;i<n;i++){{x='<p>'}}</script></body>"


def measure(seed=5, n=120):
    rng = random.Random(seed)
    texts = [" ".join(sentence(rng) for _ in range(3)) for _ in range(60)] + LINKS
    model = op.fit(op.composed([x for x in texts if len(x.split()) >= 4]))
    right = wrong = missed = 0
    for k in range(n):
        body = article(rng)
        found = op.blocks((table_page, blog_page, news_page)[k % 3](rng, body))
        kept = [x for (_, x, _, _), keep in zip(found, op.label(model, [op.vectors(found)])[0], strict=True) if keep]
        right += sum(x in body for x in kept)
        wrong += sum(x not in body for x in kept)
        missed += sum(x not in kept for x in body)
    return right / (right + wrong), right / (right + missed)


def test_precision_and_recall_on_other_layouts():
    precision, recall = measure()
    assert precision >= 0.8 and recall >= 0.8, (precision, recall)


def test_vectors_see_whole_blocks():
    long = " ".join(["same"] * 200)
    a, b = (op.vectors([(op.Node(None, "", "").child("p", "p"), f"{long} {tail}", 0, 0)]) for tail in ("comment reply", "12345 67890"))
    assert not np.array_equal(a, b)


def test_unclosed_elements_and_heads_lose_no_text():
    cases = {
        "<p>one</p><textarea><p>two</p>": ["one", "two"], "<select><option>x<p>two": ["x", "two"], "<noscript><p>kept</p>": ["kept"],
        "<head><title>t</title><p>body text</p>": ["body text"], "<head><script>a<b</script><meta x><div>d</div>": ["d"], "<p>a</p><svg><text>no</text></svg><p>b</p>": ["a", "b"], "<script>x": [], "": [],
    }
    for page, texts in cases.items():
        assert [x for _, x, _, _ in op.blocks(page)] == texts, page


def test_query_on_odd_rows(spark, tmp_path):
    rng = random.Random(9)
    pages = [(k, "u", news_page(rng, article(rng)), "x") for k in range(30)] + [(100, "u", None, "x"), (101, None, "", "x"), (102, "u", "<p>" + "long text here. " * 30_000, "x"), (1, "u", "<p>x</p>", "x"), (None, "u", "<p>y</p>", "x")]
    spark.createDataFrame(pages, "page_id long, url string, html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    got = op.query(spark, str(tmp_path)).collect()
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id in (100, 101)} == {""}
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/empty/pages.parquet")
    assert op.query(spark, f"{tmp_path}/empty").collect() == []
