"""The ordered fold of one group of lines: a prefix tree of clusters.

Small and free of Spark: ``Tree.add`` takes the tokens of the next line,
``Tree.match`` looks one up.  Lines of different root keys never meet, so every
group is folded on its own (see ``mine``).
"""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from operator import eq

_DIGIT = re.compile("[0-9]")
CREATED, CHANGED, NONE = "cluster_created", "cluster_template_changed", "none"


@dataclass
class Rules:
    """What the fold needs of the settings."""

    engine: str = "position"
    sim_th: float = 0.4
    depth: int = 4
    max_children: int = 100
    max_clusters: int | None = None
    numeric_to_param: bool = True
    param: str = "<*>"
    prefix: str = "<"
    suffix: str = ">"
    mask_generalization: bool = False
    diff_ratio: float | None = None
    affix: int | None = None  # least affix length; None: off
    patterns: tuple[tuple[str, str], ...] = ()
    binning: bool = False
    score: Callable | None = None  # (template, tokens, param, with_params) -> (similarity, wildcards)
    token_rules: tuple[Callable, ...] = ()  # (new, old, param) -> template token or None

    @classmethod
    def of(cls, config) -> Rules:
        return cls(
            config.engine, config.sim_th, config.depth, config.max_children, config.max_clusters, config.parametrize_numeric_tokens, config.param, config.mask_prefix, config.mask_suffix,
            config.mask_generalization, config.diff_ratio if config.engine == "position" else None, config.min_affix_length if config.affix_preserving else None, config.regex_patterns, config.param_binning, config.score, config.token_rules,
        )


@dataclass
class Node:
    children: dict[str, Node] = field(default_factory=dict)
    ids: list[int] = field(default_factory=list)

    def walk(self):
        """Ids below, own first, children in the order in which they came."""
        yield from self.ids
        for child in self.children.values():
            yield from child.walk()


def affix_template(a: str, b: str, param: str, least: int, least_confidence: float = 0.6) -> str | None:
    short = min(len(a), len(b))
    p = next((i for i in range(short) if a[i] != b[i]), short)
    s = next((i for i in range(short - p) if a[-1 - i] != b[-1 - i]), short - p)
    confidence = min(0.6 + 0.3 * ((p + s) / ((len(a) + len(b)) / 2)), 0.95) if a or b else 0.0
    if max(p, s) < least or confidence < least_confidence:
        return None
    return a[:p] + param + a[len(a) - s :]


class Tree:
    def __init__(self, rules: Rules):
        self.rules = rules
        self.roots: dict[str, Node] = {}
        self.clusters: OrderedDict[int, list] = OrderedDict()  # id -> [tokens, size]
        self.counter = 0
        self._plain = rules.engine == "position" and rules.diff_ratio is None and rules.score is None
        self._simple = not rules.patterns and rules.affix is None and not rules.mask_generalization and not rules.token_rules
        self._patterns = [(re.compile(p), t.replace("${paramStr}", rules.param)) for p, t in rules.patterns]

    # Routing -----------------------------------------------------------------

    def root_key(self, tokens: Sequence[str]) -> str:
        if self.rules.engine == "jaccard":
            return tokens[0] if tokens else ""
        if self.rules.binning:
            return f"{len(tokens)}#{sum(t.startswith('<') and t.endswith('>') for t in tokens)}"
        return str(len(tokens))

    def _path(self, tokens: Sequence[str]) -> Sequence[str]:
        """The tokens that lead from a root to a leaf."""
        deepest = self.rules.depth - 2
        if self.rules.engine == "jaccard":
            return tokens[1 : max(1, min(deepest, len(tokens) - 1))]
        return tokens[: max(0, min(deepest, len(tokens)) - 1)]

    def _leaf(self, tokens: Sequence[str]) -> Node | None:
        node = self.roots.get(self.root_key(tokens))
        for token in self._path(tokens):
            if node is None:
                return None
            node = node.children.get(token) or node.children.get(self.rules.param)
        return node

    def _insert(self, tokens: Sequence[str], cluster: int) -> None:
        node = self.roots.setdefault(self.root_key(tokens), Node())
        for token in self._path(tokens):
            known = node.children
            if token not in known and self.routed_to_param(token, self.rules.param in known, len(known)):
                token = self.rules.param
            node = known.setdefault(token, Node())
        node.ids = [cluster] if not tokens else [i for i in node.ids if i in self.clusters] + [cluster]

    def routed_to_param(self, token: str, has_param: bool, children: int) -> bool:
        """Whether a token without a node of its own goes below the wildcard's."""
        r = self.rules
        return bool(r.numeric_to_param and _DIGIT.search(token)) or children + (not has_param) >= r.max_children

    # Scoring -----------------------------------------------------------------

    def similarity(self, template: Sequence[str], tokens: Sequence[str], with_params: bool) -> tuple[float, int]:
        param = self.rules.param
        if self.rules.score is not None:
            return self.rules.score(template, tokens, param, with_params)
        if not template:
            return 1.0, 0
        params = sum(t == param for t in template)
        if self.rules.engine == "jaccard":
            other = [t for i, t in enumerate(tokens) if template[i] != param] if len(template) == len(tokens) and params else tokens
            own = {t for t in template if t != param} if with_params else set(template)
            union = own | set(other)
            return (min(1.3 * (len(own & set(other)) / len(union)), 1.0) if union else 0.0), params
        if self.rules.diff_ratio is not None:
            constants = len(template) - params
            differ = sum(a != param and (i >= len(tokens) or a != tokens[i]) for i, a in enumerate(template))
            share = differ / constants if constants else 0.0
            score = 1 - share if share <= self.rules.diff_ratio else 0.0
            if with_params:
                score = (score * constants + params) / len(template)
            if score > 0 or params > 0:
                return score, params
        if len(template) != len(tokens):
            return 0.0, 0
        equal = sum(a == b and a != param for a, b in zip(template, tokens, strict=True))
        return (equal + (params if with_params else 0)) / len(template), params

    def _best(self, ids, tokens: Sequence[str], least: float, with_params: bool) -> int | None:
        best, top = None, (-1.0, -1)
        if self._plain and tokens:
            # The common case, counted without a Python step per token.
            param, n, known = self.rules.param, len(tokens), self.clusters
            loose = param in tokens
            for i in ids:
                if (cluster := known.get(i)) is None:
                    continue
                template = cluster[0]
                if len(template) != n:
                    score, params = 0.0, 0
                else:
                    params = template.count(param)
                    equal = sum(map(eq, template, tokens)) - (sum(a == param == b for a, b in zip(template, tokens, strict=True)) if loose else 0)
                    score = (equal + params if with_params else equal) / n
                if score > top[0] or (score == top[0] and params > top[1]):
                    best, top = i, (score, params)
            return best if best is not None and top[0] >= least else None
        for i in ids:
            if (cluster := self.clusters.get(i)) is not None and (score := self.similarity(cluster[0], tokens, with_params)) > top:
                best, top = i, score
        return best if best is not None and top[0] >= least else None

    def _find(self, tokens: Sequence[str], least: float, with_params: bool) -> int | None:
        if not tokens:
            root = self.roots.get(self.root_key(tokens))
            return root.ids[0] if root and root.ids and root.ids[0] in self.clusters else None
        leaf = self._leaf(tokens)
        return None if leaf is None else self._best(leaf.ids, tokens, least, with_params)

    # Templates ---------------------------------------------------------------

    def _token(self, new: str, old: str) -> str:
        r = self.rules
        if r.mask_generalization and len(new) > 2 and new.startswith(r.prefix) and new.endswith(r.suffix) and new != r.param:
            return r.param
        if new == old:
            return old
        for rule in r.token_rules:
            if (found := rule(new, old, r.param)) is not None:
                return found
        for pattern, template in self._patterns:
            a, b = pattern.search(new), pattern.search(old)
            if a and b and a.groups() != b.groups():
                return template
        if r.affix is not None and (found := affix_template(new, old, r.param, r.affix)) is not None:
            return found
        return r.param

    def template(self, new: Sequence[str], old: Sequence[str]) -> tuple[str, ...]:
        if len(new) == len(old):
            if self._simple:
                param = self.rules.param
                return tuple([b if a == b else param for a, b in zip(new, old, strict=True)])
            return tuple(map(self._token, new, old))
        if self.rules.engine == "position":
            raise ValueError("templates need token sequences of one length")
        shared = set(new) & set(old)
        return tuple(t if t in shared else self.rules.param for t in (new if len(new) > len(old) else old))

    # The fold ----------------------------------------------------------------

    def load(self, cluster: int, tokens: Sequence[str], size: int) -> None:
        """Put a stored cluster back."""
        self.clusters[cluster] = [tuple(tokens), size]
        self.counter = max(self.counter, cluster)
        self._insert(tokens, cluster)

    def add(self, tokens: Sequence[str]) -> tuple[int, str]:
        """Take the next line in: (cluster id, change)."""
        found = self._find(tokens, self.rules.sim_th, False)
        if found is None:
            self.counter += 1
            self.clusters[self.counter] = [tuple(tokens), 1]
            if self.rules.max_clusters is not None:
                self._evict()
            self._insert(tokens, self.counter)
            return self.counter, CREATED
        cluster = self.clusters[found]
        new = cluster[0] if cluster[0] == tuple(tokens) and not (self._patterns or self.rules.mask_generalization) else self.template(tokens, cluster[0])
        change = NONE if new == cluster[0] else CHANGED
        cluster[0], cluster[1] = new, cluster[1] + 1
        if self.rules.max_clusters is not None:
            self._touch(found)
        return found, change

    def _evict(self) -> None:
        """Drop the clusters that have been without a line for longest, down to the bound."""
        while len(self.clusters) > self.rules.max_clusters:
            self.clusters.popitem(last=False)

    def _touch(self, cluster: int) -> None:
        self.clusters.move_to_end(cluster)

    def match(self, tokens: Sequence[str], strategy: str = "never") -> int | None:
        """Id of the cluster that fits without change, or None."""
        least = 1.0 if self.rules.engine == "position" else 0.8
        found = self._find(tokens, least, True) if strategy != "always" else None
        if found is None and strategy != "never":
            root = self.roots.get(self.root_key(tokens))
            found = self._best(root.walk(), tokens, least, True) if root else None
        return found

    def compact(self) -> int:
        """Drop ids of evicted clusters from all nodes; how many there were."""
        gone, todo = 0, list(self.roots.values())
        while todo:
            node = todo.pop()
            kept = [i for i in node.ids if i in self.clusters]
            gone, node.ids = gone + len(node.ids) - len(kept), kept
            todo += node.children.values()
        return gone

    def render(self, most: int = 5) -> str:
        """The tree as indented text."""
        lines = ["<root>"]

        def show(label: str, node: Node, level: int) -> None:
            own = [i for i in node.ids if i in self.clusters]
            lines.append("\t" * level + f'"{label}"' + (f" (cluster count {len(own)})" if own else ""))
            for token, child in node.children.items():
                show(token, child, level + 1)
            lines.extend("\t" * (level + 1) + cluster_line(i, *self.clusters[i]) for i in own[:most])

        for key, node in self.roots.items():
            show(f"<L={key}>" if key.isdigit() else key, node, 1)
        return "\n".join(lines)


def cluster_line(cluster: int, tokens: Sequence[str], size: int) -> str:
    return f"ID={cluster:<5} : size={size:<10}: {' '.join(tokens)}"
