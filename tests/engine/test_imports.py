from millrace.plans import events, graphs


def test_imports_of_every_language(spark, sf):
    got = {r.rel: r.found for r in graphs.parsed_imports(spark, sf).collect()}
    assert got == {
        "a.ts": "./a ./b @lib/c ../d ./e", "b.java": "java.util.List a.b.C", "c.cs": "System.Text X", "d.rs": "std::io inner serde", "e.c": "stdio.h x/y.h", "f.rb": "json ./g", "g.html": "a.js b.js",
        "h.kt": "a.b c", "i.swift": "Foundation", "j.dart": "dart:io p.dart", "k.xyz": "lib some/path-x", "l.py": "os sys . ..a.b json", "m.py": None, "n.go": "x/y raw/z fmt esc/d",
    }


def test_symbols_are_bounded_and_distinct(spark, sf):
    texts = {(r.conv_id, r.turn): r.text for r in events.table(spark, sf, "conversations").filter("role = 'assistant'").collect()}
    for r in events.clean_symbol_arrays(spark, sf).collect():
        seen = []
        for part in texts[r.conv_id, r.turn].split("."):
            name, description = part.strip(" ").split(" ")[0].strip()[:128], part.strip()[:300]
            if name and (name, description) not in seen:
                seen.append((name, description))
        assert r.symbols == len(seen[:5])
