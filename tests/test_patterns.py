"""Patterns, symmetry and plans: no Spark here."""

import itertools
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from motifloom.plans.pattern import SHAPES, WORKLOAD, Pattern, is_acyclic, motifs
from motifloom.plans.planner import GraphStats, connected_orders, inclusion_exclusion, independent_suffix, make_plan
from motifloom.plans.symmetry import admits_one_image, automorphisms, closed, reduced, restriction_sets, restrictions

SIZES = {"p1": 24, "p2": 12, "p3": 4, "p4": 120, "p5": 4, "p6": 6, "p7": 4, "p8": 240, "rectangle": 8, "diamond": 4, "pentagon": 10, "house": 2, "hourglass": 12}


@pytest.mark.parametrize("name", SIZES)
def test_automorphisms_and_restrictions(name):
    p = Pattern.named(name)
    assert len(automorphisms(p)) == SIZES[name]
    plan = make_plan(p)
    assert admits_one_image(plan.pattern, plan.restrictions)


@pytest.mark.parametrize("name", ["p1", "p3", "p6", "rectangle", "house", "pentagon"])
def test_every_restriction_set_admits_one_image(name):
    p = Pattern.named(name)
    assert all(admits_one_image(p, r) for r in restriction_sets(p))


@pytest.mark.parametrize(("name", "suffix", "multiplicity"), [("p1", 1, 1), ("p2", 3, 6), ("p3", 2, 1), ("p4", 1, 1), ("p5", 3, 2), ("p6", 3, 1), ("p7", 2, 1), ("p8", 2, 2), ("diamond", 2, 2), ("house", 2, 1), ("hourglass", 2, 1)])
def test_suffixes(name, suffix, multiplicity):
    plan = make_plan(Pattern.named(name), iep=True)
    assert (plan.suffix, plan.multiplicity) == (suffix, multiplicity)


def test_same_shapes():
    assert Pattern.named("p6").canonical() == Pattern.named("cycle_6_tri").canonical()
    assert len(Pattern.named("p8").edges) == len(Pattern.named("clique_7_minus").edges) == 20
    assert Pattern.named("QG3") == Pattern.named("diamond")
    assert set(SHAPES) and set(WORKLOAD)


def test_motif_numbers():
    assert [len(motifs(k)) for k in (3, 4, 5)] == [2, 6, 21]


@pytest.mark.parametrize("matrix", ["", "01", "0110", "01110111x", "010001010", "111101110", "0" * 10])
def test_bad_matrices(matrix):
    with pytest.raises(ValueError):
        Pattern.from_matrix(matrix)


def test_bad_patterns():
    with pytest.raises(ValueError):
        make_plan(Pattern.of(4, [(0, 1), (2, 3)]))
    with pytest.raises(ValueError):
        make_plan(Pattern.named("p1"), "vertex", True)
    with pytest.raises(ValueError):
        make_plan(Pattern.named("p1"), "both")
    with pytest.raises(ValueError):
        Pattern.of(3, [(1, 1)])
    with pytest.raises(ValueError):
        Pattern.named("teapot")
    with pytest.raises(ValueError):
        Pattern.of(3, [(0, 1)], [1])


def test_query_files():
    p = Pattern.named("p3").with_labels((0, 1, 0, 2, 0))
    assert Pattern.parse_file(p.to_file()) == [p]
    two = "2\n3 3\n0 1\n1 2\n0 2\n4 4\n0 1\n1 3\n3 2\n2 0\n"
    assert Pattern.parse_file(two, labelled=False) == [Pattern.clique(3), Pattern.named("rectangle")]
    with pytest.raises(ValueError):
        Pattern.parse_file("1\n3 3\n0 1\n", labelled=False)
    assert Pattern.from_matrix(Pattern.named("house").to_matrix()) == Pattern.named("house")


def test_editing():
    p = Pattern.named("rectangle").with_edge(0, 3)
    assert p.canonical() == Pattern.named("diamond").canonical()
    assert p.without_edge(3, 0) == Pattern.named("rectangle")
    assert is_acyclic(3, [(0, 1), (1, 2)]) and not is_acyclic(3, [(0, 1), (1, 2), (2, 0)])


def test_closure_and_reduction():
    assert closed(((0, 1), (1, 2))) == ((0, 1), (0, 2), (1, 2))
    assert reduced(((0, 1), (0, 2), (1, 2))) == ((0, 1), (1, 2))


def test_labels_break_symmetry():
    p = Pattern.clique(3).with_labels((0, 1, None))
    assert len(automorphisms(p)) == 1
    assert restrictions(p) == ()


@given(st.lists(st.sets(st.integers(0, 6)), min_size=1, max_size=4))
@settings(max_examples=60, deadline=None)
def test_inclusion_exclusion(sets):
    want = sum(len(set(t)) == len(t) for t in itertools.product(*sets))
    items = tuple(range(len(sets)))
    got = sum(c * math.prod(len(set.intersection(*[sets[i] for i in b])) for b in blocks) for c, blocks in inclusion_exclusion(items))
    assert got == want


def test_cheapest_order_is_valid():
    stats = GraphStats(1956, 11382, 1652, 21)
    for name in ("p3", "p5", "p7", "house"):
        for model in ("triangles", "density", "rows"):
            plan = make_plan(Pattern.named(name), stats=stats, model=model, all_sets=name == "p3")
            assert admits_one_image(plan.pattern, plan.restrictions)
            assert all(plan.earlier(k) for k in range(1, plan.pattern.n))
            assert "v0" in plan.explain()


def test_connected_orders():
    assert len(connected_orders(Pattern.clique(4))) == 1
    assert independent_suffix(Pattern.clique(4)) == 1
    random.seed(3)
    p = Pattern.named("p7")
    for order in random.sample(connected_orders(p), 5):
        plan = make_plan(p, order=order)
        assert admits_one_image(plan.pattern, plan.restrictions)
