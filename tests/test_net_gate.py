"""The gate of the net pipeline: inputs that are not complete stay out."""

from helixframe.operators import chains, ordered
from helixframe.plans import catalogue, fixtures, genome


def test_blocks_of_an_incomplete_input_stay_out_of_the_net(spark, tmp_path):
    blocks = [(s * 3 + p + 15, 1, 15 * (n + 1) + p, 15 * (n + 1) + s, 9000.0, "1995-01-01", 40, "N") for n in range(2) for s in range(5) for p in range(3)]
    spark.createDataFrame(blocks, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_extendedprice double, l_shipdate string, l_quantity long, l_returnflag string"
                          ).write.parquet(f"{tmp_path}/lineitem.parquet")
    cut_off = {4, 11}
    lines = [(f, n, role) for f in range(30) for n, role in enumerate(["user", "user" if f in cut_off else "assistant"])]
    lines.append((20, 2, "user"))  # no input of the pipeline
    spark.createDataFrame(lines, "conv_id long, turn long, role string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = catalogue.queries()["net_pipeline"](spark, str(tmp_path)).collect()
    assert rows and {3 * int(r.t_name[1:]) + int(r.q_name[1:]) for r in rows} == set(range(15)) - cut_off


def test_blocks_are_written_with_their_chains_alone(spark, monkeypatch):
    blocks = [(i, "t0", 50 * i, 50 * i + 20, "q0", 50 * i, 50 * i + 20, "+", 60) for i in range(30)]
    rows = spark.createDataFrame(blocks, "block_id long, t_name string, t_start long, t_end long, q_name string, q_start long, q_end long, strand string, score long")
    log = spark.createDataFrame([("a", 1, "# end")], "file_id string, line_no int, line string")
    written, cut = [], chains.cut_lineage
    for module in (chains, ordered):
        monkeypatch.setattr(module, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    found = chains.net_pipeline(rows, 40, 100, log, "# end").collect()
    assert len(found) == 30 and rows.columns not in written


def test_nets_move_no_query_side_of_their_chains(spark, tmp_path, monkeypatch):
    rows = [(n, 1, n % 7 + 1, n % 5 + 1, 900.0 + n, "1995-01-01", 30, "NR"[n % 2]) for n in range(60)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_extendedprice double, l_shipdate string, l_quantity long, l_returnflag string"
                          ).write.parquet(f"{tmp_path}/lineitem.parquet")
    ranked, sort = [], chains.sort_chains
    monkeypatch.setattr(chains, "sort_chains", lambda df: ranked.append(df.columns) or sort(df))
    narrow = catalogue.queries()["net_to_alignments"](spark, str(tmp_path)).collect()
    assert [set(c) & {"q_name", "q_start", "q_end", "strand", "blocks"} for c in ranked] == [set()]
    fx = fixtures.Fixtures(spark, str(tmp_path))
    whole = chains.net_blocks(chains.net_pieces(genome.ranked(fx), genome.chained(fx)), genome.chained(fx)).drop("chain_id")
    assert sorted(map(str, narrow)) == sorted(map(str, whole.collect())) != []
