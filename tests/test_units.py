from lexiloom.operators.units import budgets, durations

RUN = {"68 min": (4080, 4080), "65분": (3900, 3900), "62분 57초": (3777, 3777), "{{duration|m=120}}": (7200, 7200), "{{duration|h=1|m=5}}": (3900, 3900), "70": (4200, 4200), "0:10:00": (600, 600), "1h05": (3900, 3900),
       "PT45M39S": (2739, 2739), "PT1H15M": (4500, 4500), "3,600 seconds": (3600, 3600), "1 hour 3 minutes": (3780, 3780), "1시간 10분": (4200, 4200), "900,000 ms": (900, 900), "1.25 hours": (4500, 4500), "80~90분": (4800, 5400),
       "120-130 min": (7200, 7800), "10 to 15 minutes": (600, 900), "60′21″": (3621, 3621), "an hour": (3600, 3600), "35:49 (mm:ss)": (2149, 2149), "an hour and a half": (5400, 5400), "forty-five minutes": (2700, 2700), "half an hour": (1800, 1800),
       "one hour and ten minutes": (4200, 4200), "approx. 45 minutes (without adverts)": (2700, 2700), "70 minutes per episode": (4200, 4200), "TBA": None, "varies": None, "": None, None: None}
BUD = {"$7.2M": ("krw", 9432000000), "15.100.000.000 won": ("krw", 15100000000), "19,8 Mio. EUR": ("krw", 28215000000), "\\(11.2\\times10^{9}\\) KRW": ("krw", 11200000000), "$39.1 \\times 10^{9}$ won": ("krw", 39100000000), "27억": ("krw", 2700000000),
       "222,000万円": ("krw", 19980000000), "1140万元": ("krw", 2086200000), "£27000k": ("krw", 44820000000), "{{US$|9.3 million}} per episode": ("krw_per_episode", 12183000000), "회당 2억": ("krw_per_episode", 200000000),
       "W4.6 billion (est.)": ("krw", 4600000000), "'''c. 5,900,000&nbsp;yuan'''<ref>p. 9</ref>": ("krw", 1079700000), "Undisclosed": None, "-": None, "12 zlotys": None}


def test_durations(spark):
    keys = list(RUN)
    df = spark.createDataFrame([(i, k, "clash") for i, k in enumerate(keys)], "rec_id bigint, runtime string, low string")
    got = {r.rec_id: (r.low, r.high) for r in durations(df, "rec_id", "runtime").collect()}
    assert {k: got.get(i) for i, k in enumerate(keys)} == RUN


def test_budgets(spark):
    keys = list(BUD)
    rates = spark.createDataFrame([("KRW", 1), ("USD", 1310), ("EUR", 1425), ("GBP", 1660), ("JPY", 9), ("CNY", 183), ("CNY", 183)], "currency string, krw_per_unit bigint")
    df = spark.createDataFrame([(i, k, "x") for i, k in enumerate(keys)] + [(99, None, "x")], "rec_id bigint, budget string, cur string")
    got = {r.rec_id: (r.unit, r.low) for r in budgets(df, "rec_id", "budget", rates).collect()}
    assert {k: got.get(i) for i, k in enumerate(keys)} == BUD
    r = budgets(spark.createDataFrame([(1, "between 20.6 and 28.6 billion won"), (2, "₩1.5–5.5 billion/ep"), (3, "US$4 million to US$13 million")], "rec_id bigint, budget string"), "rec_id", "budget", rates)
    assert sorted((x.low, x.high) for x in r.collect()) == [(1500000000, 5500000000), (5240000000, 17030000000), (20600000000, 28600000000)]
    assert budgets(df.limit(0), "rec_id", "budget", rates).count() == 0


def test_budget_without_currency_takes_the_default(spark):
    rates = spark.createDataFrame([("KRW", 1), ("USD", 1310)], "currency string, krw_per_unit bigint")
    df = spark.createDataFrame([(1, "3.5 billion"), (2, "2 million dollars"), (3, "unknown"), (4, "1.5-2 billion per episode"), (5, "12 zlotys"), (6, "see note 3"), (7, "about 900,000 (est.)")], "rec_id bigint, budget string")
    got = {(r.rec_id, r.unit, r.low, r.high) for r in budgets(df, "rec_id", "budget", rates, "KRW").collect()}
    assert got == {(1, "krw", 3_500_000_000, 3_500_000_000), (2, "krw", 2_620_000_000, 2_620_000_000), (4, "krw_per_episode", 1_500_000_000, 2_000_000_000), (7, "krw", 900_000, 900_000)}
    assert {r.rec_id for r in budgets(df, "rec_id", "budget", rates).collect()} == {2}


def test_amounts_at_the_end_of_the_range(spark):
    rates = spark.createDataFrame([("KRW", 1), ("USD", 1310)], "currency string, krw_per_unit bigint")
    df = spark.createDataFrame([(1, "$2.5 \\times 10^{18}$ won"), (2, "0.000001 x 10^20 USD"), (3, "9 x 10^19 won"), (4, "1 x 10^200 won"), (5, "7 x 10^0 won")], "rec_id bigint, budget string")
    got = {r.rec_id: r.low for r in budgets(df, "rec_id", "budget", rates).collect()}
    assert got == {1: 2_500_000_000_000_000_000, 2: 131_000_000_000_000_000, 5: 7}
