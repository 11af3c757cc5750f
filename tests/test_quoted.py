"""Files with quoted line breaks cut anywhere, against the reader that takes a file in one task and against plain Python."""

import csv
import io
import random
from collections import Counter

import numpy as np
import pytest

from gridmill.sources import files as S
from gridmill.sources.quoted import _follow, read_records


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "900", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def bag(df):
    return Counter(map(tuple, df.collect()))


def make(rng, rows, sep, quotes):
    def field():
        letters = ["a", "b", " ", "é", "5"] + (['"', '""', "\n", sep, "\r\n", f'"{sep}"', "\n\n"] if quotes else [])
        return "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 12, 60])))
    out = io.StringIO()
    writer = csv.writer(out, delimiter=sep, lineterminator="\n")
    writer.writerow(["k", "body", "other"])
    want = [(str(i), field(), field()) for i in range(rows)]
    writer.writerows(want)
    return out.getvalue(), Counter((k, a or None, b or None) for k, a, b in want)


@pytest.mark.parametrize("sep,quotes,seed", [(",", True, 1), (";", True, 2), ("|", True, 3), ("\t", True, 4), (",", False, 5)])
def test_cut_files_read_like_whole_ones(spark, small_ranges, tmp_path, sep, quotes, seed):
    text, want = make(random.Random(seed), 300, sep, quotes)
    (tmp_path / "a.csv").write_bytes(text.encode())
    path = str(tmp_path / "a.csv")
    assert spark.read.text(path).rdd.getNumPartitions() > 5
    good, bad = S.read_csv(spark, path, sep)
    assert bag(good) == want and bad.count() == 0
    assert bag(good) == bag(S.read_csv(spark, path, sep, split=False)[0])


def test_ragged_and_stray_quotes(spark, small_ranges, tmp_path):
    lines = ["a,b,c"]
    for i in range(200):
        lines += [f'{i},5" pipe,x', f'{i},"two\nlines, ""q"" {"z" * (i % 70)}"', f'{i},"shut"junk,y', "", f'{i},1,2,3', f'{i},"x\n\ny",1,extra', f'{i}']
    (tmp_path / "r.csv").write_text("\n".join(lines))
    whole, cut = (S.read_csv(spark, str(tmp_path), split=s) for s in (False, True))
    assert bag(cut[0]) == bag(whole[0])
    assert Counter(r[0].rstrip("\n") for r in whole[1].collect()) == Counter(r[0] for r in cut[1].collect())


def test_one_field_over_many_ranges_and_an_open_end(spark, small_ranges, tmp_path):
    long = "\n".join(f'line {i}, ""said"" {i}' for i in range(400))
    (tmp_path / "o.csv").write_text(f'a,b\n1,"{long}"\n2,x\n\n\n3,"never\nshut\n4,5')
    want = Counter([("1", long.replace('""', '"')), ("2", "x")])
    got = bag(S.read_csv(spark, str(tmp_path))[0])
    assert want <= got and sum(got.values()) == 3
    assert got == bag(S.read_csv(spark, str(tmp_path), split=False)[0])


def test_headers_marks_and_carriage_returns(spark, small_ranges, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'\r\n\xef\xbb\xbf'[2:] + b'k,"two\nnames"\r\n' + b"".join(b'%d,"v\r\nw"\r\n' % i for i in range(90)))
    (tmp_path / "b.csv").write_text('\n\n"two\nnames",k,\n' + "".join(f"x{i},{i},\n" for i in range(90)))
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "d.csv").write_text("k\n")
    got = bag(S.read_csv(spark, str(tmp_path))[0].select("k", "`two\nnames`"))
    assert got == Counter([(str(i), "v\r\nw") for i in range(90)] + [(str(i), f"x{i}") for i in range(90)])


def test_nothing_to_read(spark, tmp_path):
    (tmp_path / "e.csv").write_text("\n\n")
    assert S.parse_lines(spark, str(tmp_path), ["a", "b"])[0].count() == 0
    (tmp_path / "e.csv").write_text("a,b\n")
    good, bad = S.read_csv(spark, str(tmp_path))
    assert good.columns == ["a", "b"] and good.count() == 0 and bad.count() == 0


def test_latin_letters(spark, small_ranges, tmp_path):
    (tmp_path / "l.csv").write_bytes("a,b\n".encode() + "".join(f'{i},"é\nß"\n' for i in range(60)).encode("latin-1"))
    assert bag(S.read_csv(spark, str(tmp_path), encoding="latin-1")[0]) == Counter((str(i), "é\nß") for i in range(60))


def test_whole_lines_are_not_shuffled(spark, tmp_path):
    (tmp_path / "p.csv").write_text("a,b\n1,2\n")
    plan = read_records(spark, [str(tmp_path)])._jdf.queryExecution().optimizedPlan().toString()
    single = plan.split("Aggregate")[0]
    assert "Union" in single and "Sort" not in single


def test_states_follow_both_hypotheses():
    rng = np.random.default_rng(7)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        a, b = rng.random(n) < .4, rng.random(n) < .6
        for state in (False, True):
            want, s = [], state
            for x, y in zip(a, b):
                s = bool(y) if s else bool(x)
                want.append(s)
            assert _follow(a, b, state).tolist() == want
