"""What op7_extraction reads as text where scripts and attributes look like markup."""

from __future__ import annotations

import time

import numpy as np
import pytest

from gleanline.llm.op7_extraction import _hash, PATH, blocks, vectors

PAGES = [
    ("<script>for(i=0;i<n;i++){a()}</script><p>The article text.</p>", ["The article text."]),
    ("<script>var s=\"<a href='\"+u;</script><p>It's one.</p><p>Don't.</p>", ["It's one.", "Don't."]),
    ("<p title=it's>One two.</p><p>Don't.</p>", ["One two.", "Don't."]),
    ("<style>a>b{content:'<p'}</style><p>x</p>", ["x"]),
    ("<head><title>a <b</title><script>if(a<b)c='</p>'</script></head><body><p>x</p>", ["x"]),
    ("<head><script>x='<body>'</script><meta a=b></head><p>x</p>", ["x"]),
    ("<textarea><p it's</textarea><p>x</p>", ["x"]),
    ("<script>var a='<!--';</script><p>x</p><!-- <p>y --><p>z</p>", ["x", "z"]),
    ("<SCRIPT src=a>1<b</Script ><p>x</p>", ["x"]),
    ("<p>x</p><script>never closed <p>y</p>", ["x"]),
    ("<script>a</scripts>b</script><p>x</p>", ["x"]),
    ("<svg><title>a <b</title><path d='M<3'/></svg><p>x</p>", ["x"]),
    ("<svg><script/><path/></svg><p>x</p>", ["x"]),
    ("<p title='a>b' class = \"c>d\" id=e>x</p>", ["x"]),
    ("<p \"a\">x</p><a href='u'class=\"v\">y</a>", ["x", "y"]),
    ("<p title=\"open>x</p><p>It's y</p>", ["x", "It's y"]),
    ("<noscript><p>no</p></noscript><p>x</p>", ["x"]),
    ("<head><title>T</title>Hello world this is text", ["Hello world this is text"]),
    ("<head><title>T</title>\n<noscript>no</noscript> \n<style>a</style>text<p>x</p>", ["text", "x"]),
    ("<svg><svg></svg>leak</svg><p>x</p>", ["x"]),
    ("<noscript>a<noscript>b</noscript>c</noscript><p>x</p>", ["x"]),
    ("<svg><svg></svg><p>x</p>", ["x"]),
    ("<svg><canvas></svg><p>x</p>", ["x"]),
    ("<p>x</p><!-- never <b>closed</b> tail", ["x"]),
    ("<p>x</p>tail <!-- open", ["x", "tail"]),
    ("<p>one < two", ["one < two"]),
    ("x <a y", ["x <a y"]),
    ("", []),
]


@pytest.mark.parametrize(("page", "texts"), PAGES)
def test_texts(page, texts):
    assert [text for _, text, _, _ in blocks(page)] == texts


MEGABYTE = 1_000_000
BROKEN = ["<div>word ", "<a ", "<!x ", "<a x='", '<a x="', "<script>", "</scriptx><script>", "<b><li>", "<div></p>", "<svg>", "<textarea>", "<ul><b>", "<td><li>", "<!--", "<head>", "<i></b>", "<?", "<a =", "< "]


@pytest.mark.parametrize("part", BROKEN)
@pytest.mark.parametrize("end", ["", ">", "</p>text"])
def test_a_megabyte_of_broken_markup_is_read_in_time(part, end):
    page = part * (MEGABYTE // len(part)) + end
    began = time.process_time()
    found = blocks(page)
    vectors(found[:20_000])
    assert time.process_time() - began < 8


def test_deep_paths_cost_a_step_a_tag():
    began = time.process_time()
    found = blocks("<div>word " * (MEGABYTE // 10))
    assert len(found) == MEGABYTE // 10 and vectors(found).shape[0] == len(found)
    assert time.process_time() - began < 12


def test_path_vectors_against_a_plain_sum():
    page = "<body id=main>" + "".join(f"<div class='c{'abc'[k % 3]} x'>" for k in range(9)) + "deep</div>up<p role=note>p"
    for (node, *_), got in zip(blocks(page), vectors(blocks(page)), strict=True):
        want, up = np.zeros(PATH), 0
        while node is not None and node.entry:
            for word in node.entry.split():
                k, sign = _hash(word, PATH)
                want[k] += sign * max(0.25, 1 - 0.15 * up)
            node, up = node.parent, up + 1
        assert np.allclose(got[:PATH], want, atol=1e-5)
