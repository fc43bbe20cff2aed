"""The tolerant parser: what it loads and what it leaves out."""

import pytest

from surgelight.sources.messages import parse_messages

DATE = "Mon Jan 02 15:04:05 -0700 2006"
REST = "u,0,t,True,a,b,c,w"
GOOD = {
    "counts that are no numbers, an empty user, true in lower case": (f"1,{DATE},,x,t,true,a,b,c,w", 1136239445, "", "t", False),
    "eleven fields": (f"1,{DATE},{REST},more", 1136239445, "u", "t", True),
    "another day of the week, uneven spaces": (f"1,Tue  Jan 2\t15:04:05 -0700 2006,{REST}", 1136239445, "u", "t", True),
    "quotes and a line break": (f'"1","{DATE}","u","0","a ""q"", b\nline","False","0","0","0","w"', 1136239445, "u", 'a "q", b\nline', False),
    "only the first record counts": (f"\n\r\n1,{DATE},{REST}\r\n2,3", 1136239445, "u", "t", True),
    "any case, a fraction, a far zone": (f"1,mon JAN 2 3:04:05.5 +2400 2006,{REST}", 1136084645, "u", "t", True),
    "a very long text": (f"1,{DATE},u,0,{'x' * 100_000},True,a,b,c,w", 1136239445, "u", "x" * 100_000, True),
}
BAD = [None, "", "\n", "a,b,c", f"1,{DATE},u,0,t,True,a,b,c", f"id_str,{DATE},{REST}", f"1,created_at,{REST}", f'1,{DATE},u,0,t"x,True,a,b,c,w', f'"1"x,{DATE},{REST}', f'1,{DATE},u,0,"open,True,a,b,c,w',
       f"1,Mon Feb 30 15:04:05 -0700 2006,{REST}", f"1,Mon Jan 0 15:04:05 -0700 2006,{REST}", f"1,Mon Jan 2 24:04:05 -0700 2006,{REST}", f"1,Jan 2 15:04:05 -0700 2006,{REST}", f"1,invalid-date-string,{REST}"]


@pytest.fixture(scope="module")
def loaded(spark):
    rows = [(name, body, "kept") for name, (body, *_) in GOOD.items()] + [(f"bad {i}", body, "kept") for i, body in enumerate(BAD)]
    return parse_messages(spark.createDataFrame(rows + rows[:1], "case string, body string, unix string")).collect()


def test_what_loads(loaded):
    assert sorted(r.case for r in loaded) == sorted([*GOOD, next(iter(GOOD))])
    for r in loaded:
        assert (r.unix, r.user_id_str, r.text, r.retweeted) == GOOD[r.case][1:] and r.id_str == "1"


def test_columns_and_empty_table(spark):
    df = spark.createDataFrame([], "body string, text int, _f int, c0 int")
    assert parse_messages(df).columns == ["_f", "c0", "id_str", "unix", "user_id_str", "retweet_count", "text", "retweeted"]
    assert parse_messages(df).count() == 0
