"""Every row of the input tables reaches the queries."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from probeframe.plans import registry

#: order, line, part, supplier, quantity: lines 1 to 7, part 2 without a second line
LINES = [(1, n, 1, n, 4.0 + n) for n in range(1, 8)] + [(2, n, 2, n, 9.0) for n in (1, 3, 4)]


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    order, line, part, supplier, quantity = (list(c) for c in zip(*LINES, strict=True))
    pq.write_table(pa.table({"l_orderkey": order, "l_linenumber": pa.array(line, pa.int32()), "l_partkey": part, "l_suppkey": supplier, "l_quantity": quantity}), where / "lineitem.parquet")
    pq.write_table(pa.table({"p_partkey": [1, 2], "p_size": pa.array([10, 20], pa.int32())}), where / "part.parquet")
    return str(where)


def test_audits_take_all_problems(spark, sf_dir):
    run = lambda name: registry.QUERIES[name](spark, sf_dir).collect()
    pids = {f"{o}-{n}-{p}-{s}" for o, n, p, s, _ in LINES}
    verdicts = run("variant_status")
    assert {(r["item_id"], r["v"]) for r in verdicts} == {(p, v) for p in pids for v in range(5)} and len(verdicts) == 5 * len(pids)
    assert {r["item_id"] for r in run("item_status")} == pids
    assert sum(r["n"] for r in run("status_counts")) == len(pids)
    listed = [(reason, r["item_id"]) for r in verdicts for reason in r["reasons"].split(",") if reason]
    assert {(r["reason"], r["n"], r["n_items"]) for r in run("reason_breakdown")} == {(k, sum(x == k for x, _ in listed), len({i for x, i in listed if x == k})) for k, _ in listed}
    assert {r["variant_id"] for r in run("proper_nouns")} == {f"{p}_v{v}" for p in pids for v in range(3)}
    sizes = {1: 10, 2: 20}
    broken = sum((int(q) + v) % 4 == 0 for *_, q in LINES for v in range(3))
    mismatched = 3 * sum((int(q) + sizes[p]) % 17 == 0 for _, _, p, _, q in LINES)
    want = {"SUBSTRING_ARTIFACT": broken, "LEFTOVER_NAME": broken, "CONSISTENCY": broken, "NUMBER_GRAPH_MISMATCH": mismatched}
    assert {r["status"]: r["n"] for r in run("entity_counts")} == {k: n for k, n in want.items() if n}
    assert len(run("entity_audit")) == sum(want.values())


def test_large_numbers_have_a_magnitude(spark, tmp_path):
    texts = {1: "7 and 1000000000000000", 2: "9" * 16, 3: "1" + "0" * 25, 4: "1 999999999999999", 5: "no number", 6: "-" + "2" * 20, 7: "12.5"}
    pq.write_table(pa.table({"doc_id": list(texts), "text": list(texts.values())}), tmp_path / "documents.parquet")
    got = {r["doc_id"]: (r["magnitude"], r["digits"]) for r in registry.QUERIES["number_magnitude"](spark, str(tmp_path)).collect()}
    assert {k: d for k, (_, d) in got.items()} == {1: 16, 2: 17, 3: 26, 4: 15, 6: 20, 7: 2}  # sixteen nines are 1e16 as a double
    assert got[1][0] == pytest.approx(15, abs=1e-6) and got[3][0] == pytest.approx(25, abs=1e-6) and got[6][0] == pytest.approx(19.346787, abs=1e-6)


def test_consensus_takes_the_answers_of_all_lines(spark, sf_dir):
    got = {r["variant"]: (r["n_answers"], r["consensus"], r["votes"]) for r in registry.QUERIES["consensus"](spark, sf_dir).collect()}
    # by model (supplier % 5): part 1 has 9, 10, 11, 7, 8; part 2, without a second line, 9 three times
    assert got == {1: (5, 9.0, 1), 2: (3, 9.0, 3)}


@pytest.mark.parametrize("sent", [100_000, 0])
def test_each_solution_is_read_and_changed_once(spark, tmp_path, monkeypatch, sent):
    from probeframe.plans import item_plans

    monkeypatch.setattr(item_plans, "MOST_SENT", sent)
    quantity = [19.0, 9.0, 12.5, None]  # of a thousand problems each; 9 gets another digit, a null makes no solution
    n = 4000
    pq.write_table(pa.table({"l_orderkey": range(n), "l_linenumber": pa.array([3] * n, pa.int32()), "l_partkey": [1] * n, "l_suppkey": [i % 7 for i in range(n)], "l_quantity": [quantity[i % 4] for i in range(n)]}), tmp_path / "lineitem.parquet")
    pq.write_table(pa.table({"p_partkey": [1], "p_size": pa.array([10], pa.int32())}), tmp_path / "part.parquet")
    made = registry.QUERIES["locked_mutation"](spark, str(tmp_path))
    assert "ArrowEvalPython" not in made._jdf.queryExecution().optimizedPlan().toString()  # no text of a single problem is read
    got = {r["item_id"]: tuple(r)[1:] for r in made.collect()}
    want = {19.0: (None, 20.0 * 10 - 3, "Depot 5", "crates", "parts"), 9.0: ("digit class", None, "Depot 2", "crates", "parts"), 12.5: (None, 13.0 * 10 - 3, "Depot 5", "crates", "parts")}
    assert got == {f"{i}-3-1-{i % 7}": want[q] for i in range(n) if (q := quantity[i % 4])}
    run = {r["pid"]: r["accepted"] for r in registry.QUERIES["forward_execute"](spark, str(tmp_path)).collect()}
    assert run == {f"{i}-3-1-{i % 7}": quantity[i % 4] is not None for i in range(n)}
