import json

import pytest

from conftest import POSITIONS
from placemap.operators.layers import map_layers
from placemap.plans import jobs
from placemap import schemas
from placemap.sources import readers, storage, writers

BOM = b"\xef\xbb\xbf"


def _file(folder, name, text, bom=False):
    path = folder / name
    path.write_bytes((BOM if bom else b"") + text.encode("utf-8"))
    return str(path)


def test_distances_bind_by_position(spark, tmp_path):
    path = _file(tmp_path, "d.csv", "地點一,地點二,里程,里程\n鄯善,且末,720,700\n且末,精絕,2000,1900\n")
    rows = [tuple(r) for r in readers.read_distances(spark, path, run_id=3).collect()]
    assert rows == [(3, "鄯善", "且末", 720, 700), (3, "且末", "精絕", 2000, 1900)]


def test_bad_number_stops_the_read(spark, tmp_path):
    path = _file(tmp_path, "d.csv", "a,b,li,li\nx,y,far,1\n")
    with pytest.raises(Exception, match="far|without coordinates"):
        readers.read_distances(spark, path).collect()


def test_directions_with_bom_and_without_header(spark, tmp_path):
    path = _file(tmp_path, "r.csv", "鄯善,且末,西\n且末,精絕,西南\n", bom=True)
    rows = [tuple(r)[1:] for r in readers.read_directions(spark, path).collect()]
    assert rows == [("鄯善", "且末", "西"), ("且末", "精絕", "西南")]


def _truth_file(folder):
    def line(names, lon, lat):
        cells = [""] * 27
        for at, name in names.items():
            cells[at] = name
        cells[23], cells[24] = str(lon), str(lat)
        return ",".join(cells)

    lines = [",".join(f"h{i}" for i in range(27)), line({2: "x", 22: "b"}, 80.5, 40.25), line({12: "a"}, 89.0, 40.0)]
    return _file(folder, "t.csv", "\n".join(lines) + "\n")


def test_ground_truth_of_a_wide_file(spark, tmp_path):
    rows = readers.read_ground_truth(spark, _truth_file(tmp_path)).orderBy("row_no").collect()
    assert [r.aliases[0] for r in rows] == ["x", None] and [r.aliases[6] for r in rows] == ["b", None]
    assert rows[1].aliases[5] == "a" and (rows[0].lon, rows[0].lat) == (80.5, 40.25)


def test_ground_truth_without_coordinates_is_refused(spark, tmp_path):
    text = ",".join(f"h{i}" for i in range(25)) + "\n" + "," * 24 + "\n"
    with pytest.raises(Exception, match="far|without coordinates"):
        readers.read_ground_truth(spark, _file(tmp_path, "t.csv", text)).collect()


def test_classes_last_line_and_override_win(spark, tmp_path):
    path = _file(tmp_path, "c.csv", "鄯善,1\n且末,2\n鄯善,3\n都護治/烏壘,9\n")
    assert {r.name: r.group_id for r in readers.read_classes(spark, path).collect()} == {"鄯善": 3, "且末": 2, "都護治/烏壘": 1}
    assert {r.name: r.group_id for r in readers.read_classes(spark, path, {"new": 7}).collect()}["new"] == 7


def test_saved_samples_get_cycling_clusters(spark, tmp_path):
    lines = [f"{run},p{i:02d},80.0,40.0" for run in range(2) for i in range(8)]
    rows = readers.read_samples_lonlat(spark, _file(tmp_path, "s.csv", "\n".join(lines) + "\n")).collect()
    assert {r.name: r.cluster for r in rows} == {f"p{i:02d}": i % 6 for i in range(8)} and len(rows) == 16


def test_saved_map_becomes_layers(spark, table, tmp_path):
    positions = table(POSITIONS, [(0, "a", 600.0, 500.0), (0, "b", 550.0, 480.0)])
    origin = (89.0, 40.0)
    paths = {k: str(tmp_path / k) for k in ("positions", "samples", "errors", "layers", "parquet")}
    writers.write_positions_lonlat(positions, origin, paths["positions"])
    writers.write_samples_lonlat(positions, origin, paths["samples"])
    writers.write_samples_lonlat(positions, origin, paths["parquet"], format="parquet")
    errors = table("run_id long, place_a string, place_b string, error double", [(0, "a", "b", 0.012)])
    writers.write_edge_errors(errors, positions, origin, paths["errors"])
    layers = jobs.layers_from_files(spark, paths["positions"], paths["samples"], paths["errors"], _truth_file(tmp_path))
    writers.write_layers(layers, paths["layers"])
    drawn = [json.loads(r.value) for r in spark.read.text(paths["layers"]).collect()]
    assert sorted(d["layer"] for d in drawn) == ["edge", "node", "node", "sample", "sample", "truth", "truth"]
    edge = next(d for d in drawn if d["layer"] == "edge")
    assert edge["colour"] == "#ff9999" and edge["tooltip"] == "1.2%" and edge["end_name"] == "b"
    a = next(d for d in drawn if d["layer"] == "node" and d["name"] == "a")
    assert (a["lon"], a["lat"]) == pytest.approx(origin) and a["colour"] == "brown"
    assert spark.read.parquet(paths["parquet"]).count() == 2


def test_unknown_truth_is_not_drawn(table):
    points = table("name string, lon double, lat double, cluster int", [("a", 1.0, 1.0, 0), ("b", None, None, 0)])
    edges = table(
        "start_name string, start_lon double, start_lat double, end_name string, end_lon double, end_lat double, err_val double", []
    )
    drawn = map_layers(points.filter("lon > 0"), points.filter("lon > 0"), points, edges)
    assert {(r.layer, r.name) for r in drawn.collect()} == {("node", "a"), ("sample", "a"), ("truth", "a")}


def test_classes_of_several_files_follow_their_names(spark, tmp_path):
    folder = tmp_path / "classes"
    folder.mkdir()
    (folder / "b.csv").write_text("x,2\ny,2\n")
    (folder / "c.csv").write_text("x,3\n")
    (folder / "a.csv").write_text("y,1\n" * 50 + "x,1\n")
    got = {r.name: r.group_id for r in readers.read_classes(spark, str(folder), overrides={"z": 9}).collect()}
    assert got == {"x": 3, "y": 2, "z": 9}


def test_several_runs_need_a_folder_each(spark, table, tmp_path):
    positions = table(POSITIONS, [(0, "a", 1.0, 2.0), (5, "a", 3.0, 4.0)])
    with pytest.raises(ValueError):
        writers.write_positions(positions, str(tmp_path / "mixed"))
    writers.write_positions_lonlat(positions, (89.84, 40.53), str(tmp_path / "runs"), by_run=True)
    rows = readers.read_positions_lonlat(spark, str(tmp_path / "runs"))
    assert rows.columns == ["run_id", "name", "lon", "lat", "cluster"] and {r.run_id for r in rows.collect()} == {0, 5}


def test_rejects_and_good_rows_are_all_rows(spark, tmp_path):
    path = _file(tmp_path, "d.csv", "a,b,li,li\nx,y,far,1\nx,y,3,4\nx,y\nx,y,1,2,3\n")
    good, bad = readers.with_rejects(spark, path, schemas.DISTANCES_CSV, header=True)
    assert [tuple(r) for r in good.collect()] == [("x", "y", 3, 4)]
    assert {r.line: r.reason for r in bad.collect()} == {
        "x,y,far,1": "no bigint in li_eval", "x,y": "no bigint in li_eval", "x,y,1,2,3": "wrong number of columns",
    }


def test_rejects_can_be_counted_alone_and_name_their_lines(spark, tmp_path):
    """Several files, cut into several parts each; with both tables every line that is not blank is accounted for."""
    folder = tmp_path / "many"
    folder.mkdir()
    wanted = {}
    for f in range(3):
        lines = ["a,b,li,li"]
        for i in range(2, 3002):
            lines.append("" if i % 50 == 0 else f"x{i},y,{'far' if i % 7 == 0 else i},{i}")
            if i % 50 and i % 7 == 0:
                wanted[f"f{f}.csv", i] = lines[-1]
        (folder / f"f{f}.csv").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        good, bad = readers.read_distances(spark, str(folder), run_id=4, rejects=True)
        assert bad.count() == len(wanted) and good.count() == 3 * 2940 - len(wanted)
        assert bad.select("line").distinct().count() == len(set(wanted.values()))
        assert {(r.file.rsplit("/", 1)[1], r.line_no): r.line for r in bad.collect()} == wanted
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert good.columns == ["run_id", "place_a", "place_b", "li_eval", "li_spring"] and good.select("run_id").distinct().count() == 1


def test_every_reader_offers_rejects(spark, tmp_path):
    cells = [""] * 25
    truth = [",".join(f"h{i}" for i in range(25))]
    for name, lon, lat in (("a", "80.5", "40"), ("b", "east", "40"), ("c", "", "40")):
        cells[2], cells[23], cells[24] = name, lon, lat
        truth.append(",".join(cells))
    cases = [
        (readers.read_distances, "h,h,h,h\na,b,1,2\na,b,1\n", "a,b,1", "no bigint in li_spring"),
        (readers.read_directions, "a,b,西\na,b,西,c\n", "a,b,西,c", "wrong number of columns"),
        (readers.read_classes, "a,1\nb,one\n", "b,one", "no int in group_id"),
        (readers.read_positions_lonlat, "a,80,40\nb,80,north\n", "b,80,north", "no double in lat"),
        (readers.read_samples_lonlat, "0,a,80,40\nzero,a,80,40\n", "zero,a,80,40", "no bigint in run_id"),
        (readers.read_edge_errors, "a,1,2,b,3,4,0.5\na,1,2,b,3,?,0.5\n", "a,1,2,b,3,?,0.5", "no double in end_lat"),
    ]
    for i, (read, text, line, reason) in enumerate(cases):
        path = _file(tmp_path, f"{i}.csv", text, bom=i == 1)
        good, bad = read(spark, path, rejects=True)
        assert bad.count() == 1 and [(r.line, r.reason) for r in bad.collect()] == [(line, reason)]
        kept = tmp_path / f"kept{i}.csv"
        kept.write_bytes((tmp_path / f"{i}.csv").read_bytes().replace((line + "\n").encode(), b""))
        strict = read(spark, str(kept))
        assert good.schema == strict.schema and sorted(map(tuple, good.collect())) == sorted(map(tuple, strict.collect()))
    good, bad = readers.read_ground_truth(spark, _file(tmp_path, "t.csv", "\n".join(truth) + "\n"), rejects=True)
    assert [(r.aliases[0], r.lon, r.lat) for r in good.collect()] == [("a", 80.5, 40.0)]
    assert sorted((r.line_no, r.reason) for r in bad.collect()) == [(3, "no double in lon"), (4, "no double in lon")]


def test_rejects_of_files_by_run(spark, tmp_path):
    for run, text in ((3, "a,80,40\nb,?,40\n"), (8, "a,81,41\n")):
        (tmp_path / "runs" / f"run_id={run}").mkdir(parents=True)
        (tmp_path / "runs" / f"run_id={run}" / "part.csv").write_text(text)
    good, bad = readers.read_positions_lonlat(spark, str(tmp_path / "runs"), rejects=True)
    assert {r.run_id for r in good.collect()} == {3, 8} and [(r.run_id, r.line_no) for r in bad.collect()] == [(3, 2)]


def test_step_tables_are_discarded(spark):
    storage.discard(spark)
    tables = [storage.stored(spark.range(3)) for _ in range(2)]
    assert sum(t.count() for t in tables) == 6
    assert storage.discard(spark) == 2 and storage.discard(spark) == 0
