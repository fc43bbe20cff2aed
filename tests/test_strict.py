from surgelight.sources.strict import load_strict, reject_reasons

GOOD = '"123","Mon Jan 02  15:04:05 -0700 2006","user1","0","a ""quoted"", text\nof two lines","True","0","0","0","w"'
BARE = "124,Tue Jan 03 15:04:05 +0000 2006,user1,7,plain text,False,0,0,0,plain text"


def _bodies(spark, bodies):
    return spark.createDataFrame([(i, b, "x", i, 5) for i, b in enumerate(bodies)], "line_no bigint, body string, record string, _n bigint, c0 int")


def reasons(spark, bodies):
    return {r.line_no: r.reason for r in reject_reasons(_bodies(spark, bodies)).collect()}


def test_valid_rows(spark):
    rows = load_strict(_bodies(spark, [GOOD, BARE])).orderBy("line_no").collect()
    assert [r.record.text for r in rows] == ['a "quoted", text\nof two lines', "plain text"]
    assert rows[0].record.unix == 1136239445 and rows[0].record.retweeted and rows[1].record.retweet_count == 7
    assert rows[1]["_n"] == 1 and rows[1].c0 == 5
    assert reasons(spark, [GOOD, BARE]) == {}


def test_reasons(spark):
    change = lambda i, x: ",".join(x if k == i else f for k, f in enumerate(BARE.split(",")))
    cases = [
        (None, "body is null"),
        ("", "body is blank"),
        (" \t\n", "body is blank"),
        ("123,abc", "too few fields"),
        (BARE + ",more", "too many fields"),
        ('"12', "a quoted field does not end"),
        (change(4, 'a "b" c'), "quotes or line breaks outside a quoted field"),
        (change(4, "a\nb"), "quotes or line breaks outside a quoted field"),
        (change(0, "12a"), "id_str is not digits"),
        (change(0, "１２"), "id_str is not digits"),
        (change(0, ""), "id_str is not digits"),
        (change(1, "invalid-date-string"), "created_at is no real date"),
        (change(1, "Thu Feb 30 15:04:05 +0000 2006"), "created_at is no real date"),
        (change(1, "Tue Jan 00 15:04:05 +0000 2006"), "created_at is no real date"),
        (change(1, "Tue Jan 03 25:04:05 +0000 2006"), "created_at is no real date"),
        (change(1, "Mon Jan 03 15:04:05 +0000 2006"), "created_at is no real date"),
        (change(2, ""), "user_id_str is empty"),
        (change(3, "1e3"), "retweet_count is not digits"),
        (change(5, "true"), "retweeted is neither True nor False"),
        (change(8, "-2"), "hashtag is not digits"),
    ]
    assert reasons(spark, [c for c, _ in cases]) == {i: r for i, (_, r) in enumerate(cases)}


def test_headers_repeats_and_long_bodies(spark):
    header = "id_str,created_at,user_id_str,retweet_count,text,retweeted,at,http,hashtag,words"
    second = "id_str,x,y"
    third = "x,created_at,y"
    long = BARE.replace("plain text,False", '"' + '""' * 100_000 + 'é" ,False')
    well = BARE.replace("plain text,False", '"' + '""a' * 100_000 + '",False')
    got = reasons(spark, [header, second, third, "bad", "bad", long, well])
    assert set(got) == {3, 4, 5}
    assert load_strict(_bodies(spark, [well])).first().record.text == '"a' * 100_000


def test_repeated_and_null_offsets(spark):
    df = spark.createDataFrame([(1, BARE), (1, "bad"), (None, "bad"), (None, BARE)], "line_no bigint, body string")
    assert sorted(str(r.line_no) for r in reject_reasons(df).collect()) == ["1", "None"]


def test_empty_table(spark):
    df = _bodies(spark, [])
    assert load_strict(df).count() == 0 and reject_reasons(df).count() == 0
