"""Literals against Python's own, profiles of reference texts and faults of wishes against plain versions."""

import ast
import json
import random
import re

from pyspark.sql import functions as F

from sojourn.functions import literals, text
from sojourn.operators import profiles
from sojourn.sources import tables


def test_literals(spark):
    cells = ["{'name': \"O'Hare\"}", "('a', 1)", "['it\\'s', \"say \\\"hi\\\"\"]", "[1, 2.5, None, True, False]", "{'b', 'a'}", "{1: (2, 3)}", "'plain'", "\"x\"", "[1, 2", "hello", "", "   ", None, "{\"a\": [1, null]}", "None", "true", "b'x'", "1+2j", "['\\u00e9\\n']", "()", "[" * 3000 + "]" * 3000, "{'a': {'b': [('c',)]}}", " ['a'] "]
    want = ['{"name":"O\'Hare"}', '["a",1]', '["it\'s","say \\"hi\\""]', "[1,2.5,null,true,false]", '["a","b"]', '{"1":[2,3]}', '"plain"', '"x"', '"[1, 2"', '"hello"', '""', '""', "null", '{"a":[1,null]}', "null", "true", '"b\'x\'"', '"1+2j"', '["é\\n"]', "[]", json.dumps("[" * 3000 + "]" * 3000), '{"a":{"b":[["c"]]}}', '["a"]']
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, cell string")
    got = {r.i: r.cell for r in tables.parsed_cells(df, ["cell"]).collect()}
    assert [got[i] for i in range(len(cells))] == want
    lists = {r.i: r.v for r in df.select("i", text.literal_list(F.col("cell")).alias("v")).collect()}
    assert lists[1] == ["a", "1"] and lists[2] == ["it's", 'say "hi"'] and lists[4] == ["a", "b"] and lists[9] is None
    for c in cells:
        if isinstance(c, str) and literals.literal_json(c) is not None and "{'b'" not in c and "{1" not in c:
            assert json.loads(literals.literal_json(c)) == json.loads(json.dumps(ast.literal_eval(c.strip())))


def test_city_error(spark):
    df = spark.createDataFrame([("Rome",), ("Rom",), (None,)], "c string")
    got = [r.e for r in df.select(text.city_error(F.col("c"), F.array(F.lit("Rome"), F.lit("Peoria"))).alias("e")).collect()]
    assert got == [None, "Rom is not valid city in ['Rome', 'Peoria'].", "None is not valid city in ['Rome', 'Peoria']."]


def plain_profile(parts):
    """table to what its sections say, line by line."""
    floats, ints, out = re.compile(profiles.FLOATS), re.compile(profiles.INTS), {"number": {}, "rows": {}, "values": {}, "names": None, "section": {}}
    n_names = 0
    for description, content in parts:
        low = description.lower()
        table = next((t for w, t in (("restaurants", "restaurant"), ("accommod", "accommodation"), ("attractions", "attraction"), ("flight", "flight"), ("self-driving", "ground"), ("taxi", "ground")) if w in low), None)
        if table is None:
            continue
        out["section"][table] = out["section"].get(table, 0) + 1
        found, rows, names = {}, 0, []
        for line in content.splitlines():
            t = line.strip()
            if not t or (table in profiles.HEADERS and t.lower().startswith(tuple(profiles.HEADERS[table]))):
                continue
            fl, it = [float(x) for x in floats.findall(t)], [int(x) for x in ints.findall(t)]
            if table == "restaurant":
                rows += 1
                found.setdefault("restaurant.avg_cost", []).extend(it[:1])
                found.setdefault("restaurant.rating", []).extend(fl[:1])
            elif table == "accommodation":
                rows += 1
                found.setdefault("accommodation.price", []).extend(fl[:1])
                found.setdefault("accommodation.review", []).extend(fl[-1:] if len(fl) >= 2 else [])
                found.setdefault("accommodation.minimum_nights", []).extend(fl[1:2] if len(fl) >= 3 else [])
                found.setdefault("accommodation.maximum_occupancy", []).extend(it[-1:])
            elif table == "flight":
                words = t.split()
                at = [i for i, w in enumerate(words) if re.match(profiles.CLOCK, w)]
                if len(at) < 2 or not at[0] or not re.match(profiles.NUMBER, words[at[0] - 1]):
                    continue
                rows += 1
                found.setdefault("flight.price", []).append(float(words[at[0] - 1]))
                if m := re.search(r"(\d+)\s*hours?\s*(\d+)\s*minutes?", t, re.I):
                    found.setdefault("flight.duration_minutes", []).append(int(m[1]) * 60 + int(m[2]))
                found.setdefault("flight.distance", []).append(next(float(w) for w in reversed(words) if re.match(profiles.NUMBER, w)))
            elif table == "attraction" and (m := floats.search(t)):
                name = t[: m.start()].strip()
                if name and name not in names and len(names) < 30:
                    names.append(name)
        if table == "ground":
            cost, hours = re.search(r"cost:\s*(\d+(?:\.\d+)?)", content, re.I), re.search(r"duration:\s*(\d+)\s*hours?\s*(\d+)\s*mins?", content, re.I)
            for mode, k in (("self-driving", "self_driving"), ("taxi", "taxi")):
                if mode in low and cost:
                    found[f"ground.{k}_cost"] = [float(cost[1])]
                if mode in low and hours:
                    found[f"ground.{k}_duration_minutes"] = [int(hours[1]) * 60 + int(hours[2])]
        for f, xs in found.items():
            if xs:
                before = out["number"].get(f, []) if table == "flight" else []
                out["number"][f] = before + xs
        if table in ("restaurant", "accommodation", "flight") and (rows or table in out["rows"]):
            out["rows"][table] = out["rows"].get(table, 0) + (rows if table == "flight" else max(0, rows - 1))
        if table == "attraction":
            n_names += len(names)
            out["names"] = (n_names, names[:25])
        for f, t, known in (("restaurant.cuisine", "restaurant", profiles.CUISINES), ("accommodation.house_rule", "accommodation", profiles.ROOM_RULES), ("accommodation.room_type", "accommodation", profiles.ROOM_TYPES)):
            hits = {k for k in known if t == table and re.search(rf"\b{k}\b", content)}
            if hits:
                out["values"][f] = sorted(set(out["values"].get(f, [])) | hits)[:10]
    return out


def made_sections(rnd):
    pick = rnd.choice
    num = lambda: pick(["12", "7", "3.5", "4.25", "100", "0.0", "2022-03-05", "v1.2.3", "x"])
    line = lambda: " ".join([pick(["Bar", "The Inn", "Name", "No smoking", "Italian", "Italians", "entire home/apt", "Private Room", "Zoo"]), *(num() for _ in range(rnd.randint(0, 5)))])
    flight = lambda: " ".join([pick(["F123", "flight"]), pick(["250", "x", "3.5"]), pick(["07:30", "7:30"]), pick(["09:10", "25:10"]), pick(["1 hours 40 minutes", "2 hour 5 minute", ""]), "Rome", pick(["693", "12.5", ""])])
    out = []
    for _ in range(rnd.randint(0, 7)):
        d = pick(["Restaurants in Rome", "Accommodations in Rome", "Attractions in Rome", "Flight from Rome to Peoria", "Self-driving from Rome", "Taxi from Rome", "Taxi or self-driving", "Weather", ""])
        if "Flight" in d:
            c = "\n".join(flight() for _ in range(rnd.randint(0, 5)))
        elif "riving" in d or "Taxi" in d:
            c = pick(["self-driving, from A to B, duration: 6 hours 47 mins, distance: 693 km, cost: 34", "no valid information", "cost: 3.5", "Duration: 1 hour 2 min"])
        else:
            c = "\n".join([pick(["Name Cost", "Description", ""]), *(line() for _ in range(rnd.randint(0, 6)))])
        out.append((d, c))
    return out


def test_profiles(spark):
    rnd = random.Random(7)
    every = {i: made_sections(rnd) for i in range(120)}
    rows = [(i, repr([{"Description": d, "Content": c} for d, c in parts])) for i, parts in every.items()] + [(900, "no list"), (901, None), (902, "{'Description': 'x'}")]
    parts = profiles.sections(spark.createDataFrame(rows, "k int, ref string"), "k", "ref")
    assert parts.where("k >= 900").count() <= 1
    got = profiles.profile(parts, "k").collect()
    for i, own in every.items():
        want, mine = plain_profile(own), [r for r in got if r.k == i]
        number = {r.field: (r["count"], r.least, r.most) for r in mine if r.type == "number"}
        assert number == {f: (len(xs), float(min(xs)), float(max(xs))) for f, xs in want["number"].items()}, (own, number, want)
        assert {r.table: r["count"] for r in mine if r.type == "rows" and r["count"]} == {t: n for t, n in want["rows"].items() if n}
        assert {r.field: r["values"] for r in mine if r.type == "values"} == want["values"]
        assert {r.table: r["count"] for r in mine if r.type == "section"} == want["section"]
        assert [(r["count"], r["values"]) for r in mine if r.type == "names"] == ([want["names"]] if want["names"] is not None else [])


def test_summary(spark):
    rows = [(1, 0, "Restaurants in Rome", "Name\nBar ITALIAN\n\nBar italians French"), (1, 1, "Flight from A", "x\ny"), (1, 2, "Taxi from A", "cost: 3"), (1, 3, "Notes", ""), (1, 4, "Accommodations", "Name\nno smoking shared room"), (2, 0, "", " ")]
    got = {r.k: r for r in profiles.summary(spark.createDataFrame(rows, "k int, place int, description string, content string"), "k").collect()}
    assert got[1].counts == {"restaurants": 2, "flights": 1, "taxi": 1, "other": 0, "accommodations": 1} and got[1].cuisines == ["French", "Italian"]
    assert got[1].room_rules == ["No smoking"] and got[1].room_types == ["Shared Room"] and got[2].descriptions == [] and got[2].counts == {"other": 0}


def test_wish_faults(spark):
    good = {"field": "restaurant.rating", "op": ">=", "value": "4", "hard": True, "alpha": 0.9, "beta": 0.1, "description": "well rated"}
    cases = [
        ({}, []), ({"description": " ab "}, ["missing_description"]), ({"description": None}, ["missing_description"]), ({"beta": 0.5}, ["alpha_beta_inconsistent", "hard_beta_too_high"]),
        ({"alpha": 0.7, "beta": 0.25}, ["hard_alpha_too_low"]), ({"hard": False, "alpha": 0.95, "beta": 0.05}, ["soft_alpha_too_high"]), ({"hard": None, "alpha": 0.95, "beta": 0.05}, []), ({"alpha": None, "beta": 0.9}, ["hard_beta_too_high"]),
        ({"value": "4.9"}, ["numeric_infeasible_or_noop"]), ({"hard": False, "value": "4.9"}, []), ({"value": '"4"'}, ["numeric_infeasible_or_noop"]), ({"value": None}, ["numeric_infeasible_or_noop"]), ({"op": "between", "value": "[1, 2]"}, []), ({"value": "1"}, ["numeric_infeasible_or_noop"]),
        ({"op": "<=", "value": "1"}, ["numeric_infeasible_or_noop"]), ({"op": "==", "value": "2"}, ["numeric_infeasible_or_noop"]), ({"field": "flight.price", "op": "<=", "value": "5900"}, []), ({"field": "flight.price", "op": ">", "value": "6001"}, ["numeric_infeasible_or_noop"]),
        ({"field": "restaurant.cuisine", "op": "in", "value": '["Italian"]'}, []), ({"field": "restaurant.cuisine", "op": "in", "value": '"French"'}, ["cuisine_not_allowed"]), ({"field": "restaurant.cuisine", "op": "in", "value": '["Thai", "Italian"]'}, ["cuisine_not_allowed"]),
        ({"field": "accommodation.room_type", "value": '"Private Room"'}, []), ({"field": "accommodation.house_rule", "value": '"No cats"'}, ["house_rule_not_allowed"]), ({"field": "ground.mode", "value": '["taxi", "bus"]'}, ["ground_mode_not_allowed"]),
        ({"field": "flight.depart_time", "value": '"07:30"'}, []), ({"field": "flight.depart_time", "value": '"7:30"'}, ["time_format"]), ({"field": "flight.arrive_time", "op": "between", "value": '["07:30", "09:00"]'}, []), ({"field": "flight.arrive_time", "op": "between", "value": '["07:30"]'}, ["time_format"]), ({"field": "flight.arrive_time", "op": ">", "value": "7"}, ["time_format"]),
        ({"field": "restaurant.count", "op": ">=", "value": "9"}, ["count_infeasible"]), ({"field": "restaurant.count", "op": ">=", "value": "3"}, []),
        ({"field": "attraction.name_keyword", "op": "contains", "value": '"Zoo"'}, []), ({"field": "attraction.name_keyword", "op": "contains", "value": '["Zoo", "x"]'}, ["keyword_not_string"]), ({"field": "attraction.name_keyword", "op": "contains", "value": "5"}, ["keyword_not_string"]),
    ]
    rows = [(1, i, *(good | more).values()) for i, (more, _) in enumerate(cases)]
    wishes = spark.createDataFrame(rows, "k int, i int, field string, op string, value string, hard boolean, alpha double, beta double, description string")
    lists = "array<string>"
    known = spark.createDataFrame([(1, "restaurant", "restaurant.rating", "number", 5, 3.1, 4.8, None), (1, "restaurant", "restaurant.rows", "rows", 5, None, None, None), (1, "restaurant", "restaurant.cuisine", "values", 1, None, None, ["Italian"])], f"k int, table string, field string, type string, count long, least double, most double, values {lists}")
    got = {r.i: (r.faults, r.kept) for r in profiles.wish_faults(wishes, known, "k", strict=True, reject_loose=True).collect()}
    for i, (more, want) in enumerate(cases):
        assert got[i] == (want, not want), (more, got[i])
    loose = {r.i: r.faults for r in profiles.wish_faults(wishes, known, "k").collect()}
    assert loose[19] == [] and loose[29] == [] and loose[13] == []
    sets = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 2), (3, None)], "k int, m int")
    expected = spark.createDataFrame([(1, 2), (2, 2), (3, 1), (4, 1), (5, 0)], "k int, n int")
    assert {r.k: r.ok for r in profiles.wish_sets(sets, "k", "m", expected).collect()} == {1: True, 2: False, 3: False, 4: False, 5: True}
