"""The command line and where its notes stand."""

from test_fixtures import sample

from tracewright.__main__ import main
from tracewright.plans.render import NAMED, colours
from tracewright.sources.ocel import write_log


def test_a_log_file_becomes_a_drawing(spark, tmp_path):
    write_log(sample(spark, "running_example"), path := str(tmp_path / "log.xml"))
    text = main([path, "--masses", "--mass", "Resin", "--implicit-mass", "Trim", "--details", "--out", out := str(tmp_path / "net.dot")])
    assert open(out, encoding="utf-8").read() == text and 'rankdir="TB"' in text
    place = next(line for line in text.splitlines() if "Resin mass: avg 14 / total 27" in line)
    assert place.lstrip().startswith("p") and "octagon" in place  # of the type's place, not of the transition
    assert next(line for line in text.splitlines() if "Implicit mass" in line).lstrip().startswith("t")


def test_some_types_have_colours_of_their_own():
    got = colours(["Truck", "A", "B"])
    assert got["Truck"] == NAMED["Truck"] == "#ff0000" and len(set(got.values())) == 3
