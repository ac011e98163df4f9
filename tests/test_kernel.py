"""The fold on small sequences, and its rules at the edges."""

import random

import pytest

from logloom.config import MinerConfig, from_ini
from logloom.operators.kernel import CHANGED, CREATED, NONE, Rules, Tree, affix_template, cluster_line

# Lines of an invented sorting hall; the expected templates follow from the rules by hand.
HALL = [
    "gate 3 north opened by badge 5512 for carrier blue",
    "gate 8 north opened by badge 1200 for carrier blue",
    "belt 2 halted after jam near chute 17 code 4",
    "belt 9 halted after jam near chute 3 code 4",
    "gate 1 north opened by badge 77 for carrier blue",
    "belt 2 halted after overload near chute 5 code 9",
]
GATE = "gate <*> north opened by badge <*> for carrier blue"
JAM = "belt <*> halted after jam near chute <*> code 4"
HALT = "belt <*> halted after <*> near chute <*> code <*>"


def run(lines, **rules):
    tree = Tree(Rules(**rules))
    out = []
    for line in lines:
        cluster, change = tree.add(line.split())
        out.append((cluster, change, " ".join(tree.clusters[cluster][0])))
    return tree, out


def templates(lines, **rules):
    return [x[2] for x in run(lines, **rules)[1]]


@pytest.mark.parametrize("engine", ["position", "jaccard"])
def test_hall(engine):
    assert templates(HALL, engine=engine) == [HALL[0], GATE, HALL[2], JAM, GATE, HALT]
    tree, out = run(["", *HALL, ""], engine=engine)
    assert [x[2] for x in out] == ["", HALL[0], GATE, HALL[2], JAM, GATE, HALT, ""]
    assert sum(size for _, size in tree.clusters.values()) == 8


def test_strict_threshold():
    # 8 of 10 tokens agree, then 8 of 10 with the template; the last line agrees in 6 only.
    assert templates(HALL, sim_th=0.75) == [HALL[0], GATE, HALL[2], JAM, GATE, HALL[5]]


@pytest.mark.parametrize("most", [1, 2, 5])
def test_eviction_of_the_longest_unused(most):
    """With exact matches only, clusters are a plain cache of lines."""
    rng = random.Random(most)
    lines = [f"{rng.choice(['tin', 'oak', 'fig'])} {rng.choice('uvw')} end" for _ in range(200)]
    tree, out = run(lines, max_clusters=most, sim_th=1.0, engine="position")
    cache, made = [], 0
    for line, (cluster, change, shown) in zip(lines, out, strict=True):
        known = dict(cache)
        assert change == (NONE if line in known else CREATED) and shown == line
        made += line not in known
        assert cluster == known.get(line, made)
        cache = [x for x in cache if x[0] != line] + [(line, cluster)]
        cache = cache[-most:]
    assert {" ".join(t) for t, _ in tree.clusters.values()} == {x for x, _ in cache}
    assert tree.compact() >= 0
    assert all(i in tree.clusters for root in tree.roots.values() for i in root.walk())


def test_changes():
    _, out = run(["lamp on in hall", "lamp off in hall", "lamp dim in hall", "door shut"])
    assert [x[1] for x in out] == [CREATED, CHANGED, NONE, CREATED]
    _, out = run(["solo", "solo", "duo"])
    assert [x[:2] for x in out] == [(1, CREATED), (1, NONE), (2, CREATED)]


@pytest.mark.parametrize("engine", ["position", "jaccard"])
def test_match(engine):
    tree, _ = run(["pump runs hot", "pump runs dry", "pump runs low", "valve stuck open"], engine=engine)
    got = [tree.match(x.split()) for x in ("pump runs slow", "valve stuck open", "valve stuck shut", "silence")]
    assert got == [1, 2, None, None]
    assert tree.match("pump runs slow".split(), "always") == 1 and tree.match("pump runs slow".split(), "fallback") == 1


def test_jaccard_lengths():
    tree, _ = run(["crate sealed; label torn", "crate sealed; label missing", "crate sealed; label half torn", "lift parked at floor six near (bay=2)", "lift raised at floor six"], engine="jaccard")
    assert [tree.match(x.split()) for x in ("crate sealed; label blank", "lift parked at floor six near (bay=7)", "silence")] == [1, 2, None]


def test_children_and_depth():
    tree, _ = run(["kilo m m", "lima m m", "mike m m"], max_children=2)
    assert tree.match("nova m m".split()) is not None
    tree, _ = run(["stock 42 moved out", "stock item counted twice"], depth=5, sim_th=0.95)
    assert len(tree.clusters) == 2
    assert "<L=4>" in tree.render()
    assert cluster_line(1, ["p", "q"], 3) == "ID=1     : size=3         : p q"


def test_own_similarity_and_token_rules():
    def ends(template, tokens, param, with_params):
        """Only first and last token count."""
        return float(template[0] == tokens[0] and template[-1] == tokens[-1]), template.count(param)

    def same_case(new, old, param):
        return "<UP>" if new.isupper() and old.isupper() else None

    tree, out = run(["job A x done", "job B y done", "job c y done", "job c y lost"], score=ends, token_rules=(same_case,))
    assert [x[2] for x in out] == ["job A x done", "job <UP> <*> done", "job <*> <*> done", "job c y lost"]


def test_templates():
    tree = Tree(Rules(param="*"))
    assert tree.template(["ox", "elk", "yak"], ["ox", "elk", "gnu"]) == ("ox", "elk", "*")
    with pytest.raises(ValueError):
        tree.template(["ox"], ["ox", "elk"])
    assert affix_template("rack7left", "rack1250left", "<*>", 2) == "rack<*>left"
    assert affix_template("slot31", "slot40", "<*>", 2) == "slot<*>"
    assert affix_template("31row", "40row", "<*>", 2) == "<*>row"
    assert affix_template("q1z", "q2z", "<*>", 2) is None
    assert affix_template("tray(1)-a", "tray(2)-a", "<*>", 2) == "tray(<*>)-a"
    assert affix_template("no1it", "no2it", "<*>", 2, 0.99) is None
    timed = Tree(Rules(patterns=((r"^(\d{2}):(\d{2})$", "${paramStr}:${paramStr}"),)))
    assert timed.template(["07:15"], ["18:40"]) == ("<*>:<*>",)


def test_config():
    for bad in ({"depth": 2}, {"sim_th": 1.5}, {"engine": "other"}):
        with pytest.raises(ValueError):
            MinerConfig(**bad)
    text = "# own file\n[DRAIN]\nengine = JaccardDrain\nsim_th = 0.7\ndepth = 5\nmax_clusters = none\nextra_delimiters = [\"_\"]\nparametrize_numeric_tokens = False\n[MASKING]\nmasking = [{\"regex_pattern\": \"q+\", \"mask_with\": \"Q\"}]\nmask_prefix = <:\n[SNAPSHOT]\ncompress_state = True\n[PROFILING]\nenabled = true\n"
    c = from_ini(text)
    assert (c.engine, c.sim_th, c.depth, c.max_clusters, c.extra_delimiters, c.parametrize_numeric_tokens) == ("jaccard", 0.7, 5, None, ("_",), False)
    assert c.masks[0].name == "Q" and c.mask_prefix == "<:" and c.param == "<:*>" and c.snapshot_compress and c.profiling
    assert c.with_(depth=6, sim_th=None).depth == 6 and from_ini("") == MinerConfig()
