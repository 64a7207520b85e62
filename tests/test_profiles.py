"""Damaged profile lines: told apart from empty fields, and never scored."""

from spokeworks.operators import scoring
from spokeworks.sources import read_checked_profiles, write_checked_profiles

LINES = {
    "1,150,20,25,true": None,
    "2,,20,,false": None,  # empty fields are no damage
    "3,,,,": None,
    "4,150,20": "few",
    "5,150,20,25,true,more": "many",
    "six,150,20,25,true": "no id",
    "7,abc,20,25,true": None,  # no number is a matter of scoring
    '8,"150,20,25,true': "quote",
}


def test_both_sides(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(2):  # a header in every file
        lines = list(LINES)[n::2]
        (tmp_path / f"in/{n}.csv").write_text("\n".join(["profile_id,riderweight,bikeweight,tirewidth,tubeless", *lines]) + "\n")
    checked = read_checked_profiles(spark, str(tmp_path / "in"))
    sound, damaged = write_checked_profiles(checked, str(tmp_path / "out"))
    assert sorted(r.damaged for r in damaged.collect()) == sorted(line for line, kind in LINES.items() if kind)
    assert sorted(r.profile_id for r in sound.collect()) == [1, 2, 3, 7]
    scored = {r.profile_id: r.psi for r in scoring.score_profiles(sound).collect()}
    assert scored == {1: 70, 2: 80, 3: 80, 7: 75}
    # Only the folder of sound profiles is read for scores.
    assert "PartitionFilters: [isnotnull(sound" in scoring.score_profiles(sound)._jdf.queryExecution().executedPlan().toString()


def test_a_file_without_damage_or_without_lines(spark, tmp_path):
    for name, text in (("whole", "1,150,20,25,true\n"), ("none", "")):
        (tmp_path / name).write_text(text)
        checked = read_checked_profiles(spark, str(tmp_path / name), header=False)
        sound, damaged = write_checked_profiles(checked, str(tmp_path / f"{name}-out"))
        assert sound.count() == len(text.splitlines()) and damaged.isEmpty()
