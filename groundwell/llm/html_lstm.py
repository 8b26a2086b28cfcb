"""A small bidirectional LSTM over a page's blocks, in numpy: inference and training.

``python -m groundwell.llm.html_lstm`` trains it anew on generated pages and
writes the weights beside this file. No page of any table is used.
"""

from __future__ import annotations

import random
import zlib
from pathlib import Path

import numpy as np

from groundwell.llm.html_blocks import PATH_BITS, Block, blocks

PATH_DIM, WORD_DIM, NUMBERS, EMBED, HIDDEN = PATH_BITS, 96, 4, 20, 12
#: Blocks whose sparse features are laid out at once.
SLICE = 4096
WEIGHTS = Path(__file__).with_name("html_lstm.npz")


class Buckets(dict):
    """A word's hashed bucket, remembered for a bounded number of them."""

    def __init__(self, size: int, most: int = 200_000) -> None:
        self.size, self.most = size, most

    def __missing__(self, name: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[name] = at = zlib.crc32(name.encode("utf-8", "surrogatepass")) % self.size
        return at


_WORDS = Buckets(WORD_DIM)


def features(page: list[Block]) -> np.ndarray:
    """A row per block: hashed marks of its tag path, hashed words, and four lengths and ratios."""
    x = np.zeros((len(page), PATH_DIM + WORD_DIM + NUMBERS), np.float32)
    paths = np.frombuffer(b"".join(b.path.to_bytes(PATH_DIM // 8, "little") for b in page), np.uint8).reshape(len(page), -1)
    x[:, :PATH_DIM] = np.unpackbits(paths, axis=1, bitorder="little")
    rows, at = [], []
    for i, b in enumerate(page):
        found = b.text.lower().split()
        at += map(_WORDS.__getitem__, found)
        rows.append((len(found), len(b.text), b.linked, b.marks))
    n, chars, linked, marks = np.asarray(rows, np.float64).reshape(-1, 4).T
    cells = np.repeat(np.arange(len(page)) * WORD_DIM, n.astype(np.int64)) + np.asarray(at, np.int64)
    x[:, PATH_DIM:-NUMBERS] = np.bincount(cells, minlength=len(page) * WORD_DIM).reshape(-1, WORD_DIM) / np.maximum(1, n)[:, None]
    x[:, -4:] = np.stack((np.log1p(chars) / 8, np.log1p(n) / 6, linked / np.maximum(1, chars), marks / 20), axis=1)
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _lstm(e: np.ndarray, live: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    """Over (T, B, E); a step with ``live`` 0 leaves the state as it was."""
    t_max, n, _ = e.shape
    h, c, out, tape = np.zeros((n, HIDDEN), e.dtype), np.zeros((n, HIDDEN), e.dtype), np.zeros((t_max, n, HIDDEN), e.dtype), []
    for t in range(t_max):
        z = e[t] @ w + h @ u + b
        i, f, o = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN]), _sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN])
        g = np.tanh(z[:, 3 * HIDDEN :])
        c2 = f * c + i * g
        h2 = o * np.tanh(c2)
        m = live[t][:, None]
        tape.append((h, c, i, f, o, g, c2, m))
        h, c = m * h2 + (1 - m) * h, m * c2 + (1 - m) * c
        out[t] = h
    return out, tape


def _lstm_back(e: np.ndarray, tape: list, w: np.ndarray, u: np.ndarray, dout: np.ndarray) -> tuple[np.ndarray, ...]:
    de, dw, du, db = np.zeros_like(e), np.zeros_like(w), np.zeros_like(u), np.zeros(4 * HIDDEN, e.dtype)
    dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
    for t in range(len(tape) - 1, -1, -1):
        h, c, i, f, o, g, c2, m = tape[t]
        dh = dh + dout[t]
        dh2, tc = dh * m, np.tanh(c2)
        dc2 = dc * m + dh2 * o * (1 - tc * tc)
        dz = np.concatenate((dc2 * g * i * (1 - i), dc2 * c * f * (1 - f), dh2 * tc * o * (1 - o), dc2 * i * (1 - g * g)), axis=1)
        dw += e[t].T @ dz
        du += h.T @ dz
        db += dz.sum(axis=0)
        de[t] = dz @ w.T
        dh, dc = dh * (1 - m) + dz @ u.T, dc * (1 - m) + dc2 * f
    return de, dw, du, db


def initial(seed: int = 0) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    s = {"in": (PATH_DIM + WORD_DIM + NUMBERS, EMBED), "fw": (EMBED, 4 * HIDDEN), "fu": (HIDDEN, 4 * HIDDEN), "bw": (EMBED, 4 * HIDDEN), "bu": (HIDDEN, 4 * HIDDEN)}
    p = {k: r.normal(0, 1 / np.sqrt(v[0] if k != "in" else 12), v) for k, v in s.items()}
    p |= {"ib": np.zeros(EMBED), "fb": np.zeros(4 * HIDDEN), "bb": np.zeros(4 * HIDDEN), "out": r.normal(0, 0.3, 2 * HIDDEN + EMBED), "ob": np.zeros(1)}
    p["fb"][HIDDEN : 2 * HIDDEN] = p["bb"][HIDDEN : 2 * HIDDEN] = 1.0
    return p


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((max(map(len, pages)), len(pages), pages[0].shape[1]), np.float32)
    live = np.zeros(x.shape[:2], np.float32)
    for j, p in enumerate(pages):
        x[: len(p), j], live[: len(p), j] = p, 1
    return x, live


def _forward(p: dict[str, np.ndarray], x: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, tuple]:
    e = np.tanh(x @ p["in"] + p["ib"])
    f, ft = _lstm(e, live, p["fw"], p["fu"], p["fb"])
    b, bt = _lstm(e[::-1], live[::-1], p["bw"], p["bu"], p["bb"])
    joint = np.concatenate((f, b[::-1], e), axis=2)
    return joint @ p["out"] + p["ob"], (e, ft, bt, joint)


def embedded(p: dict[str, np.ndarray], page: list[Block]) -> np.ndarray:
    """(blocks, EMBED); the wide sparse rows exist for ``SLICE`` blocks at a time."""
    out = np.empty((len(page), EMBED), np.float32)
    for at in range(0, len(page), SLICE):
        out[at : at + SLICE] = np.tanh(features(page[at : at + SLICE]) @ p["in"] + p["ib"])
    return out


def _run(p: dict[str, np.ndarray], e: np.ndarray) -> np.ndarray:
    """(2, T, B, HIDDEN) states of both directions over (2, T, B, EMBED), side by side and without a tape.

    A gate is half a hyperbolic tangent of half its input plus a half, so one
    call serves all four gates of both directions.
    """
    _, t_max, n, _ = e.shape
    half = np.full(4 * HIDDEN, 0.5, e.dtype)
    half[3 * HIDDEN :] = 1.0
    z = np.stack([(e[k] @ p[w] + p[b]) * half for k, (w, b) in enumerate((("fw", "fb"), ("bw", "bb")))], axis=1)
    u = np.stack([p["fu"] * half, p["bu"] * half])
    out = np.empty((t_max, 2, n, HIDDEN), e.dtype)
    h, c = np.zeros((2, n, HIDDEN), e.dtype), np.zeros((2, n, HIDDEN), e.dtype)
    s, new = np.empty((2, n, 4 * HIDDEN), e.dtype), np.empty((2, n, HIDDEN), e.dtype)
    gates, i, f, o, g = s[..., : 3 * HIDDEN], s[..., :HIDDEN], s[..., HIDDEN : 2 * HIDDEN], s[..., 2 * HIDDEN : 3 * HIDDEN], s[..., 3 * HIDDEN :]
    for t in range(t_max):
        np.matmul(h, u, out=s)
        np.add(s, z[t], out=s)
        np.tanh(s, out=s)
        np.multiply(gates, 0.5, out=gates)
        np.add(gates, 0.5, out=gates)
        np.multiply(c, f, out=c)
        np.multiply(i, g, out=new)
        np.add(c, new, out=c)
        h = out[t]
        np.tanh(c, out=h)
        np.multiply(h, o, out=h)
    return out.transpose(1, 0, 2, 3)


def main_text_odds(p: dict[str, np.ndarray], pages: list[list[Block]], budget: int = 4096) -> list[np.ndarray]:
    """Log odds of each block of each page; pages of like length run together, about ``budget`` blocks at once.

    Every page starts at the first step in either direction, so what pads a
    shorter one comes after its end and is never read.
    """
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    group: list[int] = []

    def run() -> None:
        made = [embedded(p, pages[i]) for i in group]
        e = np.zeros((2, max(map(len, made)), len(group), EMBED), np.float32)
        for j, x in enumerate(made):
            e[0, : len(x), j], e[1, : len(x), j] = x, x[::-1]
        states = _run(p, e)
        for j, (i, x) in enumerate(zip(group, made)):
            out[i] = np.concatenate((states[0, : len(x), j], states[1, : len(x), j][::-1], x), axis=1) @ p["out"] + p["ob"]

    for i in sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i])):
        if group and len(pages[i]) * (len(group) + 1) > budget:
            run()
            group = []
        group.append(i)
    if group:
        run()
    return out


def load() -> dict[str, np.ndarray]:
    with np.load(WEIGHTS) as z:
        return {k: z[k].astype(np.float32) for k in z.files}


def train(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 6, rate: float = 0.01, batch: int = 24, seed: int = 0) -> dict[str, np.ndarray]:
    """Adam on the logistic loss of (features, labels) pages."""
    p = initial(seed)
    m1, m2, step, rng = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0, random.Random(seed)
    order = sorted(range(len(pages)), key=lambda i: len(pages[i][0]))
    batches = [order[i : i + batch] for i in range(0, len(order), batch)]
    for epoch in range(epochs):
        rng.shuffle(batches)
        lost = 0.0
        for ids in batches:
            x, live = _padded([pages[i][0] for i in ids])
            x, live = x.astype(np.float64), live.astype(np.float64)
            y = np.zeros(live.shape)
            for j, i in enumerate(ids):
                y[: len(pages[i][1]), j] = pages[i][1]
            z, (e, ft, bt, joint) = _forward(p, x, live)
            prob = _sigmoid(z)
            lost -= float((live * (y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))).sum() / live.sum())
            dz = (prob - y) * live / live.sum()
            dj = dz[:, :, None] * p["out"]
            ef, fw, fu, fb = _lstm_back(e, ft, p["fw"], p["fu"], dj[:, :, :HIDDEN])
            eb, bw, bu, bb = _lstm_back(e[::-1], bt, p["bw"], p["bu"], dj[::-1, :, HIDDEN : 2 * HIDDEN])
            de = (ef + eb[::-1] + dj[:, :, 2 * HIDDEN :]) * (1 - e * e)
            grads = {
                "in": np.einsum("tbd,tbe->de", x, de), "ib": de.sum(axis=(0, 1)), "fw": fw, "fu": fu, "fb": fb, "bw": bw, "bu": bu, "bb": bb,
                "out": np.einsum("tb,tbh->h", dz, joint), "ob": np.array([dz.sum()]),
            }
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            step += 1
            lr = rate * (1 - (epoch / epochs)) ** 0.5
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                p[k] = p[k] - lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        print(f"epoch {epoch}: loss {lost / len(batches):.5f}", flush=True)
    return {k: v.astype(np.float16) for k, v in p.items()}


# --- generated pages ---------------------------------------------------------------------------

#: Class and id names by the part of the page that they mark.
MARKS = {
    "menu": "menu nav navbar navigation topnav breadcrumb breadcrumbs toc tabs main-menu site-nav pagination".split(),
    "header": "header site-header masthead topbar page-header branding logo banner".split(),
    "footer": "footer site-footer page-footer bottom copyright colophon credits legal".split(),
    "side": "sidebar side aside widget related recommended popular trending tags archive rail more-stories".split(),
    "notice": "notice cookie cookies consent gdpr alert warning message popup modal disclaimer subscribe newsletter".split(),
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion adbox banner-ad adsense".split(),
    "form": "form search login signup contact-form search-form".split(),
    "comment": "comment comments comment-list comment-body discussion replies reply responses disqus reader-comments".split(),
    "main": "content main article post entry story body text article-body post-content entry-content page-content".split(),
}
CHROME = "home about contact search login register privacy terms cookies subscribe share follow next previous more menu copyright rights reserved sponsored advertisement buy now click here read reply comments related news sitemap help".split()


class PageMaker:
    """Random pages whose main text is fenced by marks only the generator sees."""

    KEEP = "\x01"

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice("bcdfghklmnprstvwzaeiouäéñ") + self.r.choice("aeiouyrnlst") for _ in range(self.r.randint(1, 4)))

    def say(self, low: int, high: int, chrome: float = 0.0) -> str:
        n = self.r.randint(low, high)
        mess = self.r.random() < 0.06
        found = [self.r.choice(CHROME) if self.r.random() < chrome else self.word() + (self.r.choice(("***", "%%%", "$$$", "!!", "&amp;&amp;")) if mess else "") for _ in range(n)]
        return (" ".join(found)).capitalize() + self.r.choice((".", ".", ".", "", "!", "?"))

    def attr(self, part: str) -> str:
        if self.r.random() < 0.12:
            return f' class="{self.word()}"'
        names = " ".join(self.r.sample(MARKS[part], self.r.choice((1, 1, 2))))
        return f' {self.r.choice(("class", "class", "id"))}="{names}"'

    def box(self, part: str, tags: tuple[str, ...], inner: str) -> str:
        tag = self.r.choice(tags)
        plain = tag != "div" and self.r.random() < 0.6
        return f"<{tag}{'' if plain else self.attr(part)}>{inner}</{tag}>"

    def links(self, low: int = 2, high: int = 9) -> str:
        return "<ul>" + "".join(f'<li><a href="/{self.word()}">{self.say(1, 3, 0.4).rstrip(".")}</a></li>' for _ in range(self.r.randint(low, high))) + "</ul>"

    def chrome(self, part: str) -> str:
        r = self.r
        if part == "menu":
            return self.box(part, ("nav", "nav", "div"), self.links() if r.random() < 0.8 else " | ".join(f'<a href="#">{self.say(1, 2, 0.5)}</a>' for _ in range(r.randint(2, 6))))
        if part == "header":
            return self.box(part, ("header", "div"), (f"<h1>{self.say(1, 4)}</h1>" if r.random() < 0.4 else f"<p>{self.say(1, 8, 0.2)}</p>") + (self.links() if r.random() < 0.3 else ""))
        if part == "footer":
            return self.box(part, ("footer", "footer", "div"), f"&copy; {self.word()}.example.com &middot; {self.say(3, 14, 0.2)}" if r.random() < 0.6 else f"<p>{self.say(3, 30, 0.3)}</p>" + self.links(1, 5))
        if part == "side":
            return self.box(part, ("aside", "aside", "div", "section"), f"<h3>{self.say(1, 4, 0.4)}</h3>" + (self.links() if r.random() < 0.5 else f"<p>{self.say(4, 40)}</p>"))
        if part == "form":
            return f"<form{self.attr(part) if r.random() < 0.5 else ''}><label>{self.say(1, 3, 0.6)}</label><input name='q'><select><option>{self.word()}<option>{self.word()}</select><button>{self.say(1, 2, 0.8)}</button></form>"
        if part == "comment":
            one = lambda: f'<{(t := r.choice(("div", "li", "article")))} class="{r.choice(MARKS["comment"])}"><p>{self.say(3, 60)}</p></{t}>'
            return f'<{(t := r.choice(("section", "div", "ol")))} {r.choice(("id", "class"))}="{r.choice(MARKS["comment"])}"><h3>{self.say(1, 3, 0.7)}</h3>{"".join(one() for _ in range(r.randint(1, 6)))}</{t}>'
        return self.box(part, ("div",) if r.random() < 0.8 else ("section", "aside"), self.say(2, 40, 0.1) if r.random() < 0.6 else f"<p>{self.say(3, 40, 0.1)}</p>")

    def prose(self) -> str:
        r, k = self.r, self.KEEP
        n = r.choice((r.randint(1, 6), r.randint(3, 25)))
        out = [f"<h1>{k}{self.say(2, 12)}</h1>"] if r.random() < 0.8 else []
        for _ in range(n):
            x, kind = k + self.say(1, r.choice((4, 20, 80))), r.random()
            if kind < 0.08:
                out.append(f"<h2>{x}</h2>")
            elif kind < 0.14:
                out.append("<ul>" + "".join(f"<li>{k}{self.say(1, 12)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.17:
                out.append(f"<blockquote>{x}</blockquote>")
            elif kind < 0.19:
                out.append(f"<pre>{x}</pre>")
            elif kind < 0.21:
                out.append(f"<table><tr><td>{x}</td><td>{k}{self.say(1, 4)}</td></tr></table>")
            elif kind < 0.32:
                out.append(f"<p><b>{x}<br>")
            elif kind < 0.4:
                out.append(f'<p>{x} <a href="/x">{self.say(1, 3)}</a> <i>{self.say(1, 4)}</i></p>')
            elif kind < 0.46:
                out.append(f"<div>{x}</div>")
            else:
                out.append(f"<p>{x}</p>")
            if r.random() < 0.02:
                out.append(self.chrome(r.choice(("ad", "side", "notice"))))
        return "".join(out)

    def page(self) -> str:
        r = self.r
        before = [p for p, q in (("notice", 0.2), ("header", 0.35), ("menu", 0.75), ("form", 0.15), ("ad", 0.5), ("side", 0.15)) if r.random() < q]
        after = [p for p, q in (("comment", 0.3), ("side", 0.3), ("ad", 0.25), ("form", 0.15), ("notice", 0.1), ("menu", 0.1), ("footer", 0.8)) if r.random() < q]
        if r.random() < 0.3:
            r.shuffle(before)
        tag = r.choice(("article", "article", "article", "main", "div"))
        name = self.attr("main") if tag == "div" or r.random() < 0.3 else ""
        body = f"<{tag}{name}>{self.prose()}</{tag}>"
        if r.random() < 0.2:
            body = f'<div class="{r.choice(("wrap", "container", "row", "page"))}">{body}</div>'
        if r.random() < 0.03:
            body = ""
        end = "" if r.random() < 0.1 else "</body></html>"
        return "<html><body>" + "".join(map(self.chrome, before)) + body + "".join(map(self.chrome, after)) + end


def labelled(html: str) -> tuple[list[Block], np.ndarray]:
    page = blocks(html)
    y = np.array([PageMaker.KEEP in b.text for b in page], np.float64)
    for b in page:
        b.text = b.text.replace(PageMaker.KEEP, "")
    return page, y


def accuracy(p: dict[str, np.ndarray], pages: list[tuple[list[Block], np.ndarray]]) -> tuple[float, float]:
    """(share of blocks, share of whole pages) labelled right."""
    odds = main_text_odds({k: v.astype(np.float32) for k, v in p.items()}, [x for x, _ in pages])
    right = [(z > 0) == (y > 0.5) for z, (_, y) in zip(odds, pages)]
    return float(np.concatenate(right).mean()), float(np.mean([r.all() for r in right]))


if __name__ == "__main__":
    maker = PageMaker(1)
    made = [x for x in (labelled(maker.page()) for _ in range(5000)) if len(x[0])]
    weights = train([(features(x), y) for x, y in made])
    held = PageMaker(2)
    print("held out:", accuracy(weights, [x for x in (labelled(held.page()) for _ in range(1000)) if len(x[0])]))
    np.savez_compressed(WEIGHTS, **weights)
