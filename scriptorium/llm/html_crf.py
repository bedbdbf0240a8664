"""A linear-chain conditional random field over leaf blocks: features, training and Viterbi decoding.

Two labels: 0 for site furniture, 1 for main text. A block's score for label 1 over label 0 is the sum of its
features' weights; ``moves[a, b]`` scores label b after label a.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from scriptorium.llm.html_blocks import Block

#: What site furniture says, whatever holds it.
CUES = {
    "consent": r"\b(?:we|site|website|page|and our partners) uses? cookies|\baccept (?:all )?cookies|\bcookie (?:policy|settings|preferences)|utilizamos cookies|utilisons des cookies|verwenden? cookies",
    "rights": r"all rights reserved|copyright\s*(?:©|\(c\))?\s*(?:19|20)\d\d|©\s*(?:19|20)?\d*|tous droits réservés|alle rechte vorbehalten|todos los derechos",
    "letter": r"\bsubscribe to (?:our|the|my)\b|\bsign up (?:for|to)\b|\bour newsletter|\bjoin our mailing list",
    "account": r"^(?:log ?in|sign ?in|register|sign ?up|my account)\b.{0,20}$|forgot(?:ten)? (?:your )?password",
    "share": r"^(?:share|tweet|follow us|like us)\b.{0,40}$",
    "talk": r"\b(?:leave|post|write) a (?:comment|reply)|^\d+ (?:comments?|replies|responses)\b|\b(?:says|wrote|commented|replied)\s*:|^reply$",
    "more": r"^(?:related|more|recommended|popular|trending|latest|read more|you may also like)\b.{0,30}$|\badvertisement\b",
}
_CUES = {name: re.compile(pattern, re.I) for name, pattern in CUES.items()}
#: What a text must hold in lower case, or how short it must be, for a cue to be looked for at all.
_NEEDS = {
    "consent": (("cookie",), 0),
    "rights": (("rights reserved", "copyright", "©", "droits", "rechte", "derechos"), 0),
    "letter": (("subscribe to", "sign up", "newsletter", "mailing list"), 0),
    "account": (("password",), 40),
    "share": ((), 60),
    "talk": (("comment", "repl", "response", "says", "wrote"), 0),
    "more": (("advertisement",), 60),
}
_MAIN_MARKS = frozenset(("article", "main"))


def page_has_main(blocks: list[Block]) -> bool:
    """Whether any block stands in an element that says that it holds the main text."""
    return any(not _MAIN_MARKS.isdisjoint(b.element.marks) for b in blocks)


def place_features(own: str, marks: tuple[str, ...], has_main: bool) -> tuple[str, list[str]]:
    """Whether the place is in the main text's element, and the features of the place alone."""
    near = marks[0] if marks else "none"
    path = f"{near}<{marks[1] if len(marks) > 1 else 'none'}"
    inside = "none" if not has_main else "in" if not _MAIN_MARKS.isdisjoint(marks) else "out"
    return inside, ["bias", f"own:{own}", f"near:{near}", f"path:{path}", f"own+path:{own}|{path}", *(f"far:{m}" for m in marks[1:]), f"page:{inside}"]


def text_features(block: Block, inside: str) -> list[str]:
    """The features of a block's text, its links, and both with the place."""
    text = block.text
    words = text.count(" ") + 1
    size = "1" if words == 1 else "2-4" if words < 5 else "5-14" if words < 15 else "15-"
    linked = block.link_chars / max(1, len(text))
    links = "none" if linked == 0 else "some" if linked < 0.5 else "most"
    out = [f"words:{size}", f"links:{links}", f"links+page:{links}|{inside}"]
    if text[-1] in ".!?…":
        out.append("closed")
    lowered = text.lower()
    for name, (literals, short) in _NEEDS.items():
        if (len(text) <= short or any(x in lowered for x in literals)) and _CUES[name].search(text):
            near = block.element.marks[0] if block.element.marks else "none"
            out += [f"cue:{name}", f"cue+page:{name}|{inside}", f"cue+near:{'main' if near in _MAIN_MARKS else 'other'}|{size}"]
    return out


def features(block: Block, has_main: bool) -> list[str]:
    """The names of the features that hold for a block of a page that has, or has not, an element for the main text."""
    inside, out = place_features(block.element.own, block.element.marks, has_main)
    return out + text_features(block, inside)


@dataclass
class Model:
    weights: dict[str, float]
    moves: np.ndarray  # 2 x 2

    def __post_init__(self) -> None:
        @lru_cache(maxsize=1 << 14)
        def of_place(own: str, marks: tuple[str, ...], has_main: bool) -> tuple[str, float]:
            inside, names = place_features(own, marks, has_main)
            return inside, sum(self.weights.get(f, 0.0) for f in names)

        self.of_place = of_place

    def scores(self, blocks: list[Block]) -> list[float]:
        get, has_main = self.weights.get, page_has_main(blocks)
        out = []
        for b in blocks:
            inside, score = self.of_place(b.element.own, b.element.marks, has_main)
            out.append(score + sum(get(f, 0.0) for f in text_features(b, inside)))
        return out

    def decode(self, blocks: list[Block]) -> list[int]:
        """The best label sequence by Viterbi; ties go to label 1."""
        if not blocks:
            return []
        (m00, m01), (m10, m11) = self.moves.tolist()
        zero = one = 0.0
        back: list[tuple[int, int]] = []
        for i, score in enumerate(self.scores(blocks)):
            if i:
                from0, from1 = zero + m00, one + m10
                to0, to1 = zero + m01, one + m11
                back.append((int(from1 >= from0), int(to1 >= to0)))
                zero, one = max(from0, from1), max(to0, to1) + score
            else:
                zero, one = 0.0, score
        labels = [int(one >= zero)]
        for pointers in reversed(back):
            labels.append(pointers[labels[-1]])
        return labels[::-1]

    def to_json(self) -> str:
        return json.dumps({"moves": np.round(self.moves, 4).tolist(), "weights": {k: round(v, 4) for k, v in sorted(self.weights.items())}}, indent=1)

    @staticmethod
    def from_json(text: str) -> Model:
        data = json.loads(text)
        return Model(data["weights"], np.array(data["moves"]))


def train(pages: list[tuple[list[Block], list[int]]], epochs: int = 20, rate: float = 0.3, decay: float = 1e-4) -> Model:
    """Maximum likelihood by AdaGrad; the gradient is observed minus expected counts by forward and backward sums."""
    told = [([features(b, page_has_main(blocks)) for b in blocks], labels) for blocks, labels in pages if blocks]
    names = sorted({f for feats, _ in told for block in feats for f in block})
    index = {n: i for i, n in enumerate(names)}
    rows = [([[index[f] for f in block] for block in feats], np.array(labels)) for feats, labels in told]
    weights, moves = np.zeros(len(names)), np.zeros((2, 2))
    seen_w, seen_m = np.full(len(names), 1e-8), np.full((2, 2), 1e-8)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            feats, labels = rows[k]
            n = len(labels)
            score = np.zeros((n, 2))
            score[:, 1] = [weights[f].sum() for f in feats]
            ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
            ahead[0] = score[0]
            for i in range(1, n):
                ahead[i] = score[i] + np.logaddexp(ahead[i - 1, 0] + moves[0], ahead[i - 1, 1] + moves[1])
            for i in range(n - 2, -1, -1):
                step = moves + score[i + 1] + behind[i + 1]
                behind[i] = np.logaddexp(step[:, 0], step[:, 1])
            total = np.logaddexp(*ahead[-1])
            chance = np.exp(ahead[:, 1] + behind[:, 1] - total)
            grad_w, grad_m = -decay * weights, -decay * moves
            for i, f in enumerate(feats):
                grad_w[f] += labels[i] - chance[i]
            for i in range(1, n):
                grad_m -= np.exp(ahead[i - 1][:, None] + moves + score[i][None] + behind[i][None] - total)
                grad_m[labels[i - 1], labels[i]] += 1
            seen_w += grad_w**2
            seen_m += grad_m**2
            weights += rate * grad_w / np.sqrt(seen_w)
            moves += rate * grad_m / np.sqrt(seen_m)
    return Model(dict(zip(names, weights.tolist())), moves)
