import random
import re

from test_network import FF, MDP, TOP, gro

from weftgraph.cli import main
from weftgraph.sources.tsv import list_plot_tables, read_tsv


def test_build_to_tables(spark, tmp_path, capsys):
    for name, text in (("topol.top", TOP), ("ff.itp", FF), ("run.mdp", MDP), ("run.gro", gro(random.Random(4), 2))):
        (tmp_path / name).write_text(text)
    d, net = str(tmp_path), str(tmp_path / "net")
    assert main(["build", "-p", f"{d}/topol.top", "-f", f"{d}/run.mdp", "-t", f"{d}/run.gro", "-o", net, "--high-res", "ARG", "--low-res", "SOL"], spark) == 0
    assert main(["info", "-i", net, "--selector", "--list"], spark) == 0
    out = capsys.readouterr().out
    assert "kind: " in out and "operators: and, or, not" in out and "vertex_id 0-" in out
    assert main(["plot", "neighbors", "-i", net, "-o", f"{d}/n.tsv", "--target", "kind atom", "--renumber-molecule-residues", "--molecule-delimiter-min-size", "2"], spark) == 0
    assert main(["plot", "shortest_path", "-i", net, "-o", f"{d}/s.tsv"], spark) == 0
    assert main(["plot", "rave", "-i", net, "-o", f"{d}/r.tsv", "--region", "kind atom", "--region", "kind low_res"], spark) == 0
    assert main(["plot", "vmd", "-i", net, "-s", f"{d}/run.gro", "-o", f"{d}/v", "--max-edges", "5"], spark) == 0
    for name in ("n", "s", "r"):
        assert (tmp_path / f"{name}.tsv").is_file() and read_tsv(spark, f"{d}/{name}.tsv").count() > 0
    assert [p.name for p in list_plot_tables(d)] == ["n.tsv", "r.tsv", "s.tsv"] and list_plot_tables(f"{d}/n.tsv") == [tmp_path / "n.tsv"]
    n = read_tsv(spark, f"{d}/n.tsv")
    assert {"axis_residue_id", "molecule_border"} <= set(n.columns) and {r.layout for r in read_tsv(spark, f"{d}/r.tsv").collect()} <= {"overlay", "adjacent"}
    beads = (tmp_path / "v" / "network_beads.pdb").read_text().splitlines()
    assert beads[0].startswith("REMARK") and beads[-1] == "END" and beads[3].startswith("HETATM    1  ") and beads[3][20:26] == " A   1"
    assert [int(b[6:11]) for b in beads[3:-1]] == list(range(1, len(beads) - 3)) == [int(b[22:26]) for b in beads[3:-1]]
    drawn = (tmp_path / "v" / "drawer.tcl").read_text().splitlines()
    assert drawn[3:5] == ["draw delete all", "draw materials on"] and 0 < len(drawn[5:]) <= 10
    assert all(a in ("draw color red", "draw color blue") and re.fullmatch(r"draw cylinder \{.*\} \{.*\} radius [\d.]+ filled yes resolution 12", b) for a, b in zip(drawn[5::2], drawn[6::2], strict=True))
    assert "mol representation VDW 0.2500 12" in (tmp_path / "v" / "load.tcl").read_text()
    assert main(["plot", "rave", "-i", net, "-o", f"{d}/r.tsv", "--region", "kind atom", "--region", "resid 1"], spark) == 2
    assert main(["info", "-i", f"{d}/none"], spark) == 2
