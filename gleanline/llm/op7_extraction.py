"""Main text of web pages: a bidirectional LSTM in numpy labels every block with the whole page in view.

A page is cut into blocks: the runs of text between block-level tags, each with the path of tags
above it. A block's input is a vector of its path (hashed tags, ids and classes, near ones weighing
more), one of all its words (hashed), and some measures (length, links, punctuation, digits, place). The LSTM
reads the blocks forwards and backwards, so a block's label depends on the whole document. The blocks
labelled as content, joined by blank lines, are the text.

No page has labels. The model is trained on pages composed from the input's own blocks: content and
boilerplate are placed into many different page layouts, whose labels are known by construction, so
that it learns layouts and context rather than one site's template. It reads at most MAX_SAMPLE pages,
in whole: more of them only add more block texts to draw from.

Edge cases: a null or empty html, or one without content, gives an empty text; unclosed and stray
tags, comments, very long pages and unknown tags are read on to the end, nothing is capped; scripts and
the like end at their own end tag, and quotes count only after an equals sign; an element without text
that is never closed is passed over (but for scripts and styles, which run to the end), nested ones are
counted, and a head ends where the first text or tag comes that a head can't hold; the reader's time and
memory grow with a page's length, however deep its tags or broken its markup; repeated rows get equal texts; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pages of which blocks are taken for training.
MAX_SAMPLE = 400
#: Composed pages, passes over them, size of the LSTM in each direction.
N_COMPOSED, EPOCHS, HIDDEN = 900, 5, 20
PATH, WORDS, MEASURES = 64, 32, 10
WIDTH = PATH + WORDS + MEASURES
BATCH = 32

#: Tags that end a block on either side, those whose contents are no text, and those without an end tag.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
SILENT = frozenset("script style template noscript iframe object svg math canvas audio video textarea select head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:\x22[^\x22]*\x22|'[^']*'|[^\s>\x22'][^\s>]*+)?+)*+)>", re.S)
#: Tags whose contents are no markup: they end at their own end tag, whatever stands before it.
_RAW = frozenset("script style textarea title".split())
#: What a head can hold; other tags end it.
_IN_HEAD = frozenset("title meta link base basefont bgsound script style noscript template head".split())
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"\s+")
_CLOSES_P = BLOCK - {"option", "optgroup"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table tr select body html article section div nav main aside".split())


class Node:
    """A place in the tree of tags: equal entries below one place share a node, so a path is one object whatever its depth."""

    __slots__ = ("parent", "name", "entry", "below", "total", "vector")

    def __init__(self, parent: Node | None, name: str, entry: str) -> None:
        self.parent, self.name, self.entry = parent, name, entry
        self.below: dict[str, Node] = {}
        self.total = self.vector = None

    def child(self, name: str, entry: str) -> Node:
        found = self.below.get(entry)
        if found is None:
            found = self.below[entry] = Node(self, name, entry)
        return found


def blocks(page: str) -> list[tuple[Node, str, int, int]]:
    """(path, text, characters inside links, number of links) of each block of text, in page order.

    A path is a node whose entries, from it up, are a tag with its classes, ids and roles. The page is read
    once: no tag is sought behind the last `>`, and the places of end tags are looked up once for each name.
    """
    out: list[tuple[Node, str, int, int]] = []
    root = node = Node(None, "", "")
    stack: list[Node] = []
    text: list[str] = []
    silence: list[str] = []
    linked = links = in_link = begin = at = 0
    last, opened, ends = page.rfind(">") + 1, Counter(), {}

    def next_end(name: str, begin: int) -> int:
        """Where the next end tag of a name stands, or -1."""
        left = left_of(name, begin)
        return ends[name][-left] if left else -1

    def left_of(name: str, begin: int) -> int:
        """How many end tags of a name are left."""
        if name not in ends:
            ends[name] = [m.start() for m in re.finditer(rf"</{name}(?=[\s/>])", page, re.I)]
        return len(ends[name]) - bisect_left(ends[name], begin)

    def flush() -> None:
        nonlocal linked, links
        if text:
            joined = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
            if joined:
                out.append((node, joined, linked, links))
            text.clear()
        linked = links = 0

    def pop_to(k: int) -> None:
        nonlocal in_link, node
        for gone in stack[k:]:
            opened[gone.name] -= 1
            in_link -= gone.name == "a"
        del stack[k:]
        node = stack[-1] if stack else root

    def nearest(names: set[str], scopes: frozenset[str] = frozenset()) -> int:
        """The place of the innermost open element of these names that no scope hides, or -1."""
        if any(opened[n] for n in names):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name in names:
                    return k
                if stack[k].name in scopes:
                    break
        return -1

    def say(piece: str) -> None:
        nonlocal linked
        text.append(piece)
        if in_link > 0:
            linked += len(piece)

    while m := _TOKEN.search(page, begin, last):
        begin = m.end()
        if m.start() > at:
            piece = page[at : m.start()]
            if silence == ["head"] and not piece.isspace():
                silence.clear()  # text ends a head
            if not silence:
                say(piece)
        at, name = m.end(), m.group(2)
        if name is None:
            if m.group().startswith("<!--") and not m.group().endswith("-->"):
                at = len(page)  # a comment that is never closed
                break
            continue
        name, closing, empty = name.lower(), bool(m.group(1)), m.group(3).rstrip().endswith("/")
        if name in _RAW and not closing and not empty and (end := next_end(name, begin)) >= 0:
            begin = end
            if silence:
                at = end
        if silence:
            if closing and name in silence:
                del silence[len(silence) - 1 - silence[::-1].index(name) :]
            elif silence == ["head"] and not closing and name not in _IN_HEAD:
                silence.clear()
            if silence:
                if name in SILENT and not closing and not empty and left_of(name, begin) > silence.count(name):
                    silence.append(name)
                continue
            if closing:
                continue
        if closing:
            if name in BLOCK:
                flush()
            if (k := nearest({name})) >= 0:
                pop_to(k)
            continue
        if name in SILENT:
            if name == "head":
                flush()
            if not empty and (name in ("head", "script", "style") or left_of(name, begin)):
                silence.append(name)
            continue
        if name in BLOCK:
            flush()
            if name in _CLOSES_P and (k := nearest({"p"})) >= 0:
                pop_to(k)
            if name in _SIBLINGS and (k := nearest(_SIBLINGS[name], _SCOPES)) >= 0:
                pop_to(k)
        elif name == "br":
            text.append(" ")
        if name in VOID:
            continue
        marks = " ".join(p.lower() for _, a, b, c in _ATTRIBUTE.findall(m.group(3)) for p in _PARTS.findall(a or b or c)) if m.group(3) else ""
        node = node.child(name, f"{name} {marks}" if marks else name)
        stack.append(node)
        opened[name] += 1
        if name == "a":
            in_link += 1
            links += 1
    rest = page[at:].partition("<!--")[0]
    if silence == ["head"] and rest and not rest.isspace():
        silence.clear()
    if rest and not silence:
        say(rest)
    flush()
    return out


#: What the nearest entries of a path weigh beyond the rest.
_NEAR = [np.float32(w) for w in (0.75, 0.6, 0.45, 0.3, 0.15)]
_hashed: dict[tuple[str, int], tuple[int, float]] = {}


def _hash(word: str, size: int) -> tuple[int, float]:
    found = _hashed.get((word, size))
    if found is None:
        x = zlib.crc32(word.encode("utf-8", "replace"))
        if len(_hashed) > 200_000:
            _hashed.clear()
        found = _hashed[(word, size)] = (x % size, 1.0 if x & 0x8000 else -1.0)
    return found


_entries: dict[str, np.ndarray] = {}


def _own(entry: str) -> np.ndarray:
    """The vector of an entry's words."""
    found = _entries.get(entry)
    if found is None:
        if len(_entries) > 20_000:
            _entries.clear()
        found = _entries[entry] = np.zeros(PATH, np.float32)
        for word in entry.split():
            k, sign = _hash(word, PATH)
            found[k] += sign
    return found


def _path_vector(node: Node) -> np.ndarray:
    """A path's entries, the nearest weighing 1, each further one 0.15 less, 0.25 at least. Each node's unweighted sum is kept, so a page costs a step a tag."""
    if node.vector is None:
        lacking, up = [], node
        while up is not None and up.total is None:
            lacking.append(up)
            up = up.parent
        for n in reversed(lacking):
            n.total = _own(n.entry) if n.parent is None else n.parent.total + _own(n.entry)
        v, up = np.float32(0.25) * node.total, node
        for weight in _NEAR:
            v += weight * _own(up.entry)
            up = up.parent
            if up is None:
                break
        node.vector = v
    return node.vector


def vectors(found: list[tuple[Node, str, int, int]]) -> np.ndarray:
    """The inputs of a page's blocks."""
    out = np.zeros((len(found), WIDTH), np.float32)
    for k, (path, text, linked, links) in enumerate(found):
        out[k, :PATH] = _path_vector(path)
        words = text.split()
        own = np.zeros(WORDS, np.float32)
        for w, times in Counter(text.lower().split()).items():
            j, sign = _hash(w, WORDS)
            own[j] += sign * times
        out[k, PATH : PATH + WORDS] = own / np.sqrt(12 * len(words) + 4)  # long blocks weigh more, but not without bound
        n = len(text)
        out[k, PATH + WORDS :] = (
            np.log1p(len(words)) / 4, min(1.0, linked / n), min(links, 5) / 5, (text.count(".") + text.count(",")) / (len(words) + 1), text[-1] in ".!?:;\"'",
            sum(map(text.count, "0123456789")) / n, "©" in text or "|" in text, k / len(found), (len(found) - k) / len(found), min(1.0, n / len(words) / 10),
        )
    return out


class Labeller:
    """A bidirectional LSTM with a logistic output for each step."""

    def __init__(self, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"w{d}"] = rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, 4 * HIDDEN)).astype(np.float32)
            self.p[f"u{d}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.p[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
        self.p["out"] = rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32)
        self.p["direct"] = np.zeros(WIDTH, np.float32)
        self.p["bias"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, live: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (steps, pages, HIDDEN) of one direction; a page's state stays where it has no step."""
        w, u, c = (self.p[f"{k}{d}"] for k in "wuc")
        steps, pages, _ = x.shape
        fed = x @ w + c
        h = np.zeros((pages, HIDDEN), np.float32)
        cell = np.zeros_like(h)
        out = np.zeros((steps, pages, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = fed[t] + h @ u
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = np.split(gates, 3, axis=1)
            g = np.tanh(z[:, 3 * HIDDEN :])
            on = live[t][:, None]
            new = f * cell + i * g
            squashed = np.tanh(new)
            if keep is not None:
                keep.append((t, h, cell, i, f, o, g, squashed, on))
            cell = np.where(on, new, cell)
            h = np.where(on, o * squashed, h)
            out[t] = h
        return out

    def logits(self, x: np.ndarray, live: np.ndarray, keep: dict | None = None) -> np.ndarray:
        f = self._run(x, live, "f", None if keep is None else keep["f"])
        b = self._run(x, live, "b", None if keep is None else keep["b"])
        if keep is not None:
            keep["h"] = (f, b)
        return f @ self.p["out"][:HIDDEN] + b @ self.p["out"][HIDDEN:] + x @ self.p["direct"] + self.p["bias"]

    def gradients(self, x: np.ndarray, live: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        keep: dict = {"f": [], "b": []}
        z = self.logits(x, live, keep)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        mass = live * weight
        dz = ((p - y) * mass / max(mass.sum(), 1)).astype(np.float32)
        f, b = keep["h"]
        grads = {"out": np.concatenate([np.einsum("tp,tph->h", dz, f), np.einsum("tp,tph->h", dz, b)]), "direct": np.einsum("tp,tpw->w", dz, x), "bias": np.array([dz.sum()])}
        for d, part in (("f", self.p["out"][:HIDDEN]), ("b", self.p["out"][HIDDEN:])):
            u = self.p[f"u{d}"]
            gw, gu, gc = np.zeros_like(self.p[f"w{d}"]), np.zeros_like(u), np.zeros(4 * HIDDEN, np.float32)
            dh = np.zeros((x.shape[1], HIDDEN), np.float32)
            dcell = np.zeros_like(dh)
            for t, h0, cell0, i, fg, o, g, squashed, on in reversed(keep[d]):
                dh = dh + dz[t][:, None] * part
                dh_on = np.where(on, dh, 0)
                dc = np.where(on, dcell, 0) + dh_on * o * (1 - squashed**2)
                gate = np.concatenate([dc * g * i * (1 - i), dc * cell0 * fg * (1 - fg), dh_on * squashed * o * (1 - o), dc * i * (1 - g**2)], axis=1)
                gw += x[t].T @ gate
                gu += h0.T @ gate
                gc += gate.sum(axis=0)
                dh = np.where(on, gate @ u.T, dh)
                dcell = np.where(on, dc * fg, dcell)
            grads |= {f"w{d}": gw, f"u{d}": gu, f"c{d}": gc}
        loss = -(mass * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / max(mass.sum(), 1)
        return float(loss), grads


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, live = np.zeros((steps, len(pages), WIDTH), np.float32), np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], live[: len(p), k] = p, True
    return x, live


def fit(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 1) -> Labeller:
    """Adam over batches of pages of like length."""
    model, rng = Labeller(seed), np.random.default_rng(seed)
    m, v, step = {k: np.zeros_like(x) for k, x in model.p.items()}, {k: np.zeros_like(x) for k, x in model.p.items()}, 0
    by_length = sorted(range(len(pages)), key=lambda k: len(pages[k][0]))
    batches = [by_length[k : k + BATCH] for k in range(0, len(by_length), BATCH)]
    for epoch in range(epochs):
        for k in rng.permutation(len(batches)):
            x, live = padded([pages[j][0] for j in batches[k]])
            y = np.zeros(live.shape, np.float32)
            for c, j in enumerate(batches[k]):
                y[: len(pages[j][1]), c] = pages[j][1]
            _, grads = model.gradients(x, live, y, np.ones_like(y))
            step += 1
            rate = 0.02 if epoch < epochs - 2 else 0.006
            for name, g in grads.items():
                g = np.clip(g, -1, 1)
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.99 * v[name] + 0.01 * g * g
                model.p[name] = (model.p[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def label(model: Labeller, pages: list[np.ndarray]) -> list[np.ndarray]:
    """Whether each block is content, page by page."""
    out: list = [np.zeros(0, bool)] * len(pages)
    order = [k for k in sorted(range(len(pages)), key=lambda k: len(pages[k])) if len(pages[k])]
    at = 0
    while at < len(order):
        longest = len(pages[order[min(at + 127, len(order) - 1)]])
        some = order[at : at + max(1, min(128, 200_000 // longest))]
        x, live = padded([pages[k] for k in some])
        z = model.logits(x, live)
        for c, k in enumerate(some):
            out[k] = z[: len(pages[k]), c] > 0
        at += len(some)
    return out


_SERIAL = re.compile(r"\{(\d+)\}")


def composed(texts: list[str], n: int = N_COMPOSED, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training pages: inputs and labels of their blocks, from layouts around the given block texts."""
    import random

    from gleanline.llm.layouts import NOTICES, UI, compose

    rng = random.Random(seed)
    texts = [x for x in texts if "{" not in x] or NOTICES
    shorts = [" ".join(x.split()[: rng.randint(1, 3)]) for x in rng.choices(texts, k=200)] + UI
    pages = []
    for _ in range(n):
        page, marks = compose(rng, texts, shorts)
        found, clean, y = blocks(page), [], []
        for path, text, linked, links in found:
            serial = [marks[int(k)] for k in _SERIAL.findall(text)]
            bare = _SERIAL.sub("", text).strip()
            if bare and len(set(serial)) == 1:
                clean.append((path, bare, min(linked, len(bare)), links))
                y.append(serial[0] == "1")
        if clean:
            pages.append((vectors(clean), np.array(y, np.float32)))
    return pages


def train(pages: DataFrame, max_sample: int = MAX_SAMPLE) -> Labeller:
    """The labeller, fitted in one task on layouts around the blocks of at most max_sample pages (those with the least hash)."""
    keyed = pages.filter("length(html) > 0").select(F.xxhash64("page_id", "url").alias("k"), "html")
    chosen = keyed.select("k").distinct().orderBy("k").limit(max_sample)
    sample = keyed.join(F.broadcast(chosen), "k", "left_semi").select("html").distinct()  # numbers of at most max_sample rows

    def run(key: tuple, table: pa.Table) -> pa.Table:
        texts = sorted({x for page in table.column("html").to_pylist() for _, x, _, _ in blocks(page) if len(x.split()) >= 4})
        model = fit(composed(texts))
        return pa.table([pa.array(list(model.p)), pa.array([x.tobytes() for x in model.p.values()])], ["name", "value"])

    got = sample.groupBy(F.lit(0).alias("g")).applyInArrow(run, "name string, value binary").collect()  # the weights: some ten thousand numbers
    model = Labeller()
    for row in got:
        model.p[row.name] = np.frombuffer(row.value, np.float32).reshape(model.p[row.name].shape)
    return model


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """(page_id, url, text, n_blocks) of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                found = [blocks(page or "") for page in batch.column("html").to_pylist()]
                chosen = label(model, [vectors(b) if b else np.zeros((0, WIDTH), np.float32) for b in found])
                texts = ["\n\n".join(x for (_, x, _, _), keep in zip(b, c, strict=True) if keep) for b, c in zip(found, chosen, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(b) for b in found], pa.int64())], ["page_id", "url", "text", "n_blocks"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_blocks long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    out = extract(pages, train(pages))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
