"""Main text of web pages by a recurrent labeller of their text blocks (operator 12)."""

import html as entities
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimflow.llm.store import stored
from claimflow.llm.text import mixed, portions, remembered, starts_of, sums, table, words

# Bound of the fitting sample: pages, whole. Each is seen as it is, and again in other layouts, SEEN times in all.
FIT_PAGES, SEEN = 400, 1_600
EPOCHS, RATE, RIDGE = 9, 0.01, 1e-5
HIDDEN, PATH_DIM, WORD_DIM = 16, 20, 12
PATH_SLOTS, WORD_SLOTS = 1_024, 512
NUMBERS = 11
# Cells (blocks times pages) that one batch of the network holds.
CELLS = 1 << 15

# Elements of HTML by their kind.
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var img wbr picture source track input map area".split()
)
UNREAD = set("script style noscript template iframe textarea title svg math object canvas xmp noembed noframes audio video select datalist".split())
EMPTY = set("hr meta link base col param embed command keygen frame".split())
# An open element of the left kind ends where one of the right kinds begins.
ENDED_BY = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"},
    "option": {"option"},
}
# What elements and the words of class, id and role say of the text below them, by kind of page part.
MAIN = "article main".split()
MAIN_WORDS = "article content post entry story body main text".split()
PARTS = {
    "menu": ("nav menu".split(), "nav navbar navigation menu menubar breadcrumb breadcrumbs tabs toc pagination pager skip".split()),
    "header": ("header".split(), "header masthead topbar banner branding logo hero tagline".split()),
    "footer": ("footer".split(), "footer bottom copyright legal imprint colophon credits".split()),
    "sidebar": ("aside".split(), "sidebar aside rail widget related recommended recommendations popular trending teaser archive tags".split()),
    "notice": ("dialog".split(), "notice cookie cookies consent gdpr privacy alert popup modal overlay paywall newsletter subscribe signup hidden".split()),
    "advert": ((), "ad ads adv advert advertisement advertising sponsor sponsored promo promotion dfp".split()),
    "form": ("form fieldset button".split(), "form login search contact share social sharing toolbar".split()),
    "comments": ((), "comment comments commentlist discussion disqus reply replies respond reviews".split()),
}
# Elements that hold text within an article as well as elsewhere.
HOLDERS = [("ul", "li"), ("ol", "li"), ("blockquote",), ("blockquote", "p"), ("table", "tr", "td"), ("table", "tr", "th"), ("h2",), ("h3",), ("pre",)]
HOLDERS += [("figure", "figcaption"), ("dl", "dd"), ("dl", "dt"), ("div",), ("section", "p"), ("div", "p"), ("details", "summary")]
OUT = {x for tags, _ in PARTS.values() for x in tags} | {"." + x for _, names in PARTS.values() for x in names}
IN = set(MAIN) | {"." + x for x in MAIN_WORDS}

TOKEN = re.compile(
    r"""<!--(?:-?>|.*?--!?>|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>|<[!?/][^>]*>""", re.S
)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
CONCEALED = re.compile(r"""\bhidden\b|aria-hidden\s*=\s*.?true|display\s*:\s*none""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
END_OF = {name: re.compile(rf"</{name}[\s/>]", re.I) for name in UNREAD}


def _element(name: str, attributes: str) -> tuple[str, ...]:
    """What an element adds to the path: its name and the words of its class, id and role."""
    out = [name]
    for found in NAMED.finditer(attributes):
        value = found[2] or found[3] or found[4] or ""
        out += ["." + w.lower() for w in WORD.findall(value)[:12]]
    if CONCEALED.search(attributes):
        out.append(".hidden")
    return tuple(dict.fromkeys(out))


def leaves(page: str) -> list[tuple[tuple[str, ...], str, int, str, float]]:
    """The text blocks of a page in order: path, element, depth, text, share of it in links.

    The path holds the distinct names and class words from the root down. A block is the text
    between two block elements, its white space (entities decoded) single blanks.
    """
    out: list = []
    stack: list[tuple[str, tuple[str, ...]]] = [("", ())]
    pieces: list[str] = []
    chars, linked, link_at = 0, 0, -1
    pos, size = 0, len(page)

    def take(piece: str):
        nonlocal chars
        pieces.append(piece)
        chars += len(piece)

    def flush():
        nonlocal chars, linked, link_at
        if pieces:
            raw = "".join(pieces)
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                inside = linked + (chars - link_at if link_at >= 0 else 0)
                out.append((stack[-1][1], stack[-1][0], len(stack), text, min(inside / max(chars, 1), 1.0)))
            pieces.clear()
        chars, linked, link_at = 0, 0, (0 if link_at >= 0 else -1)

    while pos < size:
        m = TOKEN.search(page, pos)
        if m is None:
            take(page[pos:])
            break
        if m.start() > pos:
            take(page[pos : m.start()])
        pos = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                if link_at >= 0:
                    linked, link_at = linked + chars - link_at, -1
            elif name not in INLINE and name != "br":
                flush()
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
        elif name == "br":
            take(" ")
        elif name in UNREAD:
            end = END_OF[name].search(page, pos)
            if not m[3].endswith("/") or name not in ("svg", "math"):
                pos = page.find(">", end.start()) + 1 if end else size
                pos = pos or size
        elif name in INLINE:
            if name == "a" and link_at < 0:
                link_at = chars
        else:
            flush()
            if name in EMPTY:
                continue
            if stack[-1][0] == "p" or name in ENDED_BY.get(stack[-1][0], ()):
                stack.pop()
            above = stack[-1][1]
            new = tuple(x for x in remembered("elements", (name, m[3]), lambda: _element(name, m[3])) if x not in above)
            stack.append((name, above + new if new else above))
    flush()
    return out


def taught(path: tuple[str, ...], element: str) -> int:
    """What the markup alone says of a block: 1 main text, 0 not, -1 nothing; the teacher of the network."""
    held = set(path)
    if element == "h1" and "article" in held and (held & OUT) <= {"header", ".header"}:
        return 1
    if held & OUT:
        return 0
    return 1 if held & IN else -1


def _slot(token: str, slots: int) -> tuple[int, int]:
    """Two places of a token in a table; two tokens share both very rarely."""
    h = int(mixed(pd.util.hash_array(np.array([token], object), categorize=False))[0])
    return h % slots, (h >> 32) % slots


def path_slots(path: tuple[str, ...], element: str) -> list[int]:
    return [s for token in (*path, f"last {element}") for s in remembered("slots", token, lambda: _slot(token, PATH_SLOTS))]


def numbers(texts: pa.Array, links: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """A block's figures that do not depend on its place: lengths, shares, depth."""
    sizes = np.fromiter((len(t.encode()) for t in texts.to_pylist()), np.int64, len(texts))
    data = np.frombuffer("".join(texts.to_pylist()).encode(), np.uint8)

    def share(members: bytes) -> np.ndarray:
        flag = np.zeros(256)
        flag[list(members)] = 1
        return sums(flag[data], sizes) / np.maximum(sizes, 1)

    last = data[np.cumsum(sizes) - 1] if len(data) else np.zeros(0, np.uint8)
    blanks = share(b" ")
    return np.stack(
        [
            np.log1p(sizes) / 5,
            np.log1p(blanks * sizes) / 4,
            links,
            share(b".,;:!?") * 10,
            share(b"0123456789") * 5,
            share(bytes(range(65, 91))) * 5,
            np.isin(last, list(b".!?\"'")).astype(float),
            np.minimum(depth, 20) / 10,
        ],
        axis=1,
    )


def placed(n: np.ndarray) -> np.ndarray:
    """Figures of a block's place in its page, for pages of n blocks."""
    at = np.arange(int(n.sum())) - np.repeat(starts_of(n), n)
    whole = np.repeat(n, n)
    return np.stack([(at + 0.5) / np.maximum(whole, 1), 1 / (1 + at), np.log1p(whole) / 4], axis=1)


class Direction:
    """A long short-term memory read along one direction of padded sequences."""

    @staticmethod
    def new(rng, width: int) -> dict[str, np.ndarray]:
        bias = np.zeros(4 * HIDDEN)
        bias[HIDDEN : 2 * HIDDEN] = 1
        return {"W": rng.normal(0, 1 / np.sqrt(width), (width, 4 * HIDDEN)), "R": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN)), "b": bias}

    @staticmethod
    def run(p: dict, x: np.ndarray, held: np.ndarray, backward: bool, keep: bool):
        """Hidden states (time, page, HIDDEN) of x (time, page, width); kept gates on request."""
        steps, pages = x.shape[:2]
        h, c = np.zeros((pages, HIDDEN), x.dtype), np.zeros((pages, HIDDEN), x.dtype)
        out = np.zeros((steps, pages, HIDDEN), x.dtype)
        gates = []
        drive = (x.reshape(-1, x.shape[2]) @ p["W"] + p["b"]).reshape(steps, pages, -1)
        for t in range(steps - 1, -1, -1) if backward else range(steps):
            z = drive[t] + h @ p["R"]
            s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            before, h_before = c, h
            on = held[t][:, None]
            c = (f * c + i * g) * on
            tc = np.tanh(c)
            h = o * tc * on
            out[t] = h
            if keep:
                gates.append((t, i, f, o, g, before, h_before, tc))
        return out, gates

    @staticmethod
    def back(p: dict, x: np.ndarray, held: np.ndarray, gates: list, dout: np.ndarray):
        """Gradients of the parameters and of x."""
        pages = x.shape[1]
        dh, dc = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
        dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN))
        dR = np.zeros_like(p["R"])
        for t, i, f, o, g, before, h_before, tc in reversed(gates):
            on = held[t][:, None]
            dh = (dh + dout[t]) * on
            dc = (dc + dh * o * (1 - tc * tc)) * on
            dz = np.hstack([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)])
            dz_all[t] = dz
            dR += h_before.T @ dz
            dh, dc = dz @ p["R"].T, dc * f
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        grads = {"W": x.reshape(-1, x.shape[2]).T @ flat, "R": dR, "b": flat.sum(0)}
        return grads, (flat @ p["W"].T).reshape(x.shape)


@dataclass
class Sequences:
    """The blocks of many pages, one after the other."""

    n: np.ndarray  # blocks per page
    path: np.ndarray  # block -> row of `bags`
    bags: list[list[int]]  # slots of each distinct path
    word: np.ndarray  # slots of all words
    per_block: np.ndarray  # words per block
    figures: np.ndarray

    def batches(self):
        """Pages of like length together: block positions (time, page), and which are there."""
        order = np.argsort(self.n, kind="stable")
        order = order[self.n[order] > 0]
        begins, at = starts_of(self.n), 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and self.n[order[stop]] * (stop + 1 - at) <= CELLS:
                stop += 1
            pages = order[at:stop]
            steps = int(self.n[pages[-1]])
            grid = begins[pages] + np.arange(steps)[:, None]
            held = np.arange(steps)[:, None] < self.n[pages]
            yield np.where(held, grid, begins[pages]), held
            at = stop


def averaged(table_: np.ndarray, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean row of the table over each run of slots."""
    return sums(table_[slots], counts) / np.maximum(counts, 1)[:, None]


class Labeller:
    """Bidirectional reader of a page's blocks; the logit of a block is linear in both states."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        width = PATH_DIM + WORD_DIM + NUMBERS
        self.p = {
            "path": rng.normal(0, 0.3, (PATH_SLOTS, PATH_DIM)),
            "word": rng.normal(0, 0.3, (WORD_SLOTS, WORD_DIM)),
            "out": rng.normal(0, 0.3, 2 * HIDDEN),
            "bias": np.zeros(1),
        }
        for side in ("f", "b"):
            self.p |= {f"{side}.{k}": v for k, v in Direction.new(rng, width).items()}

    def side(self, side: str) -> dict[str, np.ndarray]:
        return {k: self.p[f"{side}.{k}"] for k in ("W", "R", "b")}

    def inputs(self, s: Sequences) -> np.ndarray:
        counts = np.array([len(b) for b in s.bags], np.int64)
        flat = np.array([x for b in s.bags for x in b], np.int64)
        bags = sums(self.p["path"][flat], counts) if len(flat) else np.zeros((len(counts), PATH_DIM))
        return np.hstack([bags[s.path], averaged(self.p["word"], s.word, s.per_block), s.figures])

    def logits(self, s: Sequences) -> np.ndarray:
        rows, out = self.inputs(s), np.zeros(len(s.path))
        for grid, held in s.batches():
            x = rows[grid]
            for side, backward in (("f", False), ("b", True)):
                weight = self.p["out"][:HIDDEN] if side == "f" else self.p["out"][HIDDEN:]
                states, _ = Direction.run(self.side(side), x, held, backward, keep=False)
                out[grid[held]] += (states @ weight)[held]
        return out + self.p["bias"][0]

    def step(self, s: Sequences, y: np.ndarray, grid: np.ndarray, held: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy of the blocks in the grid that have a label."""
        rows = self.inputs(s)
        x = rows[grid]
        forward = {side: Direction.run(self.side(side), x, held, side == "b", keep=True) for side in ("f", "b")}
        both = np.concatenate([forward["f"][0], forward["b"][0]], axis=2)
        told = held & (y[grid] >= 0)
        p = 1 / (1 + np.exp(-np.clip(both @ self.p["out"] + self.p["bias"][0], -30, 30)))
        d = np.where(told, p - y[grid], 0) / max(told.sum(), 1)
        g = {"out": np.einsum("tpk,tp->k", both, d), "bias": np.array([d.sum()])}
        dboth = d[:, :, None] * self.p["out"]
        dx = np.zeros_like(x)
        for side, part in (("f", dboth[:, :, :HIDDEN]), ("b", dboth[:, :, HIDDEN:])):
            grads, own = Direction.back(self.side(side), x, held, forward[side][1], part)
            g |= {f"{side}.{k}": v for k, v in grads.items()}
            dx += own
        drow = np.zeros_like(rows)
        np.add.at(drow, grid[held], dx[held])
        counts = np.array([len(b) for b in s.bags], np.int64)
        flat = np.array([v for b in s.bags for v in b], np.int64)
        dbag = np.zeros((len(s.bags), PATH_DIM))
        np.add.at(dbag, s.path, drow[:, :PATH_DIM])
        g["path"] = np.zeros_like(self.p["path"])
        np.add.at(g["path"], flat, np.repeat(dbag, counts, axis=0))
        dword = drow[:, PATH_DIM : PATH_DIM + WORD_DIM] / np.maximum(s.per_block, 1)[:, None]
        g["word"] = np.zeros_like(self.p["word"])
        np.add.at(g["word"], s.word, np.repeat(dword, s.per_block, axis=0))
        return g


def read(pages: list[str]) -> tuple[list[list[str]], list[tuple[tuple[str, ...], str]], Sequences]:
    """The blocks of pages: their texts, the distinct paths, and what the network reads."""
    found = [leaves(p) for p in pages]
    flat = [leaf for page in found for leaf in page]
    paths: dict[tuple, int] = {}
    path = np.array([paths.setdefault((leaf[0], leaf[1]), len(paths)) for leaf in flat], np.int64)
    texts = pa.array([leaf[3] for leaf in flat], pa.string())
    codes, per_block, distinct = words(texts)
    hashed = mixed(pd.util.hash_array(np.array(distinct.to_pylist(), object), categorize=False)) % np.uint64(WORD_SLOTS)
    n = np.array([len(page) for page in found], np.int64)
    own = numbers(texts, np.array([leaf[4] for leaf in flat]), np.array([leaf[2] for leaf in flat], np.int64))
    slots = hashed.astype(np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
    bags = [path_slots(*p) for p in paths]
    return [[leaf[3] for leaf in page] for page in found], list(paths), Sequences(n, path, bags, slots, per_block, np.hstack([own, placed(n)]))


@dataclass
class Block:
    """A block of a fitting page."""

    path: tuple[str, ...]
    element: str
    slots: np.ndarray
    figures: np.ndarray
    label: int


def _renamed(blocks: list[Block], rng) -> list[Block]:
    """The page with other elements and class words for its parts, some of them bare."""
    swaps: dict[str, tuple[str, ...]] = {}

    def other(token: str) -> tuple[str, ...]:
        if token not in swaps:
            kind = next((v for v in PARTS.values() if token in v[0] or token[1:] in v[1] and token[0] == "."), None)
            if token in IN:
                choices = [("div", "." + str(rng.choice(MAIN_WORDS))), (str(rng.choice(MAIN)),), ("section", "." + str(rng.choice(MAIN_WORDS))), ("div",), ("div",)]
            elif kind:
                choices = [("div", "." + str(rng.choice(kind[1]))), ("section", "." + str(rng.choice(kind[1])))] + [(t,) for t in kind[0]]
            else:
                choices = [(token,)]
            swaps[token] = choices[rng.integers(len(choices))]
        return swaps[token]

    return [Block(tuple(dict.fromkeys(x for t in b.path for x in other(t))), b.element, b.slots, b.figures, b.label) for b in blocks]


def _mixed_forms(blocks: list[Block], pool: list[Block], rng) -> list[Block]:
    """The page with lists, quotations, tables and headings among its main text, short ones too."""
    out = []
    for b in blocks:
        for _ in range(1 + int(b.label == 1 and rng.random() < 0.3)):
            if b.label != 1 or rng.random() < 0.5:
                out.append(b)
                continue
            holder = HOLDERS[rng.integers(len(HOLDERS))]
            words_of = pool[rng.integers(len(pool))] if rng.random() < 0.5 else b
            path = tuple(dict.fromkeys((*(t for t in b.path if t != "p"), *holder)))
            out.append(Block(path, holder[-1], words_of.slots, words_of.figures, 1))
    return out


def _crowded(blocks: list[Block], pool: list[Block], rng) -> list[Block]:
    """The page with more parts around and within its main text, their words from other pages."""
    out = list(blocks)
    for _ in range(int(rng.integers(2, 6))):
        tags, names = PARTS[list(PARTS)[rng.integers(len(PARTS))]]
        at = int(rng.integers(len(out) + 1))
        inside = 0 < at < len(out) and out[at - 1].label == 1 == out[at].label
        above = out[at].path if inside and rng.random() < 0.5 else ("html", "body")
        mark = (str(rng.choice(tags)),) if tags and rng.random() < 0.5 else ("div", "." + str(rng.choice(names)))
        if rng.random() < 0.3:
            mark = (*mark, "." + str(rng.choice(names)))
        new = []
        for _ in range(int(rng.integers(1, 6))):
            b = pool[rng.integers(len(pool))]
            holder = HOLDERS[rng.integers(len(HOLDERS))] if rng.random() < 0.5 else (str(rng.choice(["p", "div", "h1", mark[0]])),)
            new.append(Block(tuple(dict.fromkeys((*above, *mark, *holder))), holder[-1], b.slots, b.figures, 0))
        out[at:at] = new
    return out


def _joined(pages: list[list[Block]]) -> tuple[Sequences, np.ndarray]:
    flat = [b for page in pages for b in page]
    paths: dict[tuple, int] = {}
    path = np.array([paths.setdefault((b.path, b.element), len(paths)) for b in flat], np.int64)
    n = np.array([len(page) for page in pages], np.int64)
    figures = np.hstack([np.array([b.figures for b in flat]), placed(n)])
    s = Sequences(n, path, [path_slots(*p) for p in paths], np.concatenate([b.slots for b in flat]), np.array([len(b.slots) for b in flat], np.int64), figures)
    return s, np.array([b.label for b in flat])


def _sample(pages: DataFrame) -> list[list[Block]]:
    """The blocks of the FIT_PAGES pages smallest by hash; tasks cut the whole pages into blocks.

    A block's words come as the distinct slots they fall into, so a long block is not more than a table.
    """
    key = F.xxhash64(F.lit(5), F.coalesce("url", F.lit("")), F.length(F.coalesce("html", F.lit(""))))
    ids = pages.filter("page_id is not null").select(F.col("page_id").cast("bigint").alias("page_id"), key.alias("key"))
    chosen = [r[0] for r in ids.distinct().orderBy("key", "page_id").limit(FIT_PAGES).collect()]
    if not chosen:
        return []
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "html").filter(F.col("page_id").isin(chosen))
    one = stored(rows.groupBy("page_id").agg(F.min("html").alias("html")), "sample")

    def cut(batches):
        for batch in batches:
            for part in portions(batch, "html"):
                _, paths, s = read([h or "" for h in part.column("html").to_pylist()])
                ends, page_of = np.concatenate([[0], np.cumsum(s.per_block)]), np.repeat(np.arange(len(s.n)), s.n)
                ids = part.column("page_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[page_of]),
                        pa.array(np.arange(len(page_of))),
                        pa.array([list(paths[k][0]) for k in s.path], pa.list_(pa.string())),
                        pa.array([paths[k][1] for k in s.path], pa.string()),
                        pa.array([np.unique(s.word[a:b]).tolist() for a, b in zip(ends[:-1], ends[1:])], pa.list_(pa.int32())),
                        pa.array(s.figures[:, :-3].tolist(), pa.list_(pa.float64())),
                    ],
                    ["page_id", "at", "path", "element", "slots", "figures"],
                )

    found = one.mapInArrow(cut, "page_id bigint, at bigint, path array<string>, element string, slots array<int>, figures array<double>").toArrow()
    sequences: dict[int, list[Block]] = {}
    for r in found.sort_by([("page_id", "ascending"), ("at", "ascending")]).to_pylist():
        path = tuple(r["path"])
        block = Block(path, r["element"], np.array(r["slots"], np.int64), np.array(r["figures"]), taught(path, r["element"]))
        sequences.setdefault(r["page_id"], []).append(block)
    return [b for b in sequences.values() if b]


def fit(pages: DataFrame, seed: int = 3) -> Labeller | None:
    """A labeller taught by the markup of a bounded sample of pages, read in several layouts.

    The teacher knows elements and class words only; blocks it has nothing to say of count in
    the context alone. In the variants the parts' names are swapped or left out and further
    parts put in, so that the network learns to go by order, form and words as well. None
    where no block is known.
    """
    sample = _sample(pages)
    pool = [b for page in sample for b in page]
    rng = np.random.default_rng(seed)
    if not any(b.label >= 0 for b in pool):
        return None
    seen = list(sample)
    for k in range(SEEN - len(sample)):
        page, v = sample[k % len(sample)], k // len(sample) % 3
        one = _mixed_forms(_renamed(page, rng) if v else page, pool, rng)
        seen.append(_crowded(one, pool, rng) if v != 1 else one)
    model = Labeller(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    q = {k: np.zeros_like(v) for k, v in model.p.items()}
    order = np.argsort([len(page) for page in seen], kind="stable")
    groups = []
    for chunk in np.array_split(order, max(1, len(seen) // 48)):
        s, y = _joined([seen[i] for i in chunk])
        groups.append((s, y, list(s.batches())))
    t = 0
    for epoch in range(EPOCHS):
        for k in rng.permutation(len(groups)):
            s, y, batches = groups[k]
            for grid, held in batches:
                t += 1
                rate = RATE * (1 - epoch / EPOCHS) + 1e-4
                for name, g in model.step(s, y, grid, held).items():
                    g = g + RIDGE * model.p[name]
                    m[name] = 0.9 * m[name] + 0.1 * g
                    q[name] = 0.999 * q[name] + 0.001 * g * g
                    model.p[name] = model.p[name] - rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(q[name] / (1 - 0.999**t)) + 1e-8)
    return model


def main_text(pages: DataFrame, model: Labeller | None) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars, n_blocks.

    The whole page is cut into blocks, which the network labels all at once per page, with what
    stands before and after; those labelled main are joined by blank lines. Without a model
    (no page to learn from) what the markup says decides, and unmarked blocks are main text.

    A null or empty page has the empty text. Unclosed and crossed elements are read as browsers
    do in common cases; a page is one sequence however long, held by one task. Repeated rows have
    the same text; an empty table gives no rows; other columns are not read.
    """

    def extracted(batches):
        for batch in batches:
            for part in portions(batch, "html"):
                texts, paths, s = read([h or "" for h in part.column("html").to_pylist()])
                if model is None:
                    rule = np.array([taught(*p) != 0 for p in paths], bool)
                    kept = rule[s.path] if len(s.path) else np.zeros(0, bool)
                else:
                    kept = model.logits(s) > 0
                begins = starts_of(s.n)
                out = ["\n\n".join(t for t, k in zip(own, kept[b : b + len(own)]) if k) for own, b in zip(texts, begins)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64()), pa.array(s.n)],
                    ["page_id", "url", "text", "n_chars", "n_blocks"],
                )

    rows = pages.select(F.col("page_id").cast("bigint"), "url", "html")
    return rows.mapInArrow(extracted, "page_id bigint, url string, text string, n_chars bigint, n_blocks bigint")


def op12_main_text(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return main_text(pages, fit(pages)).drop("n_blocks")
