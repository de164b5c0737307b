"""Hand-derived pairs: name → (target, source, rows as (path, value), merged compact or None)."""

GOLDEN = {
    "1": ('{"a":1}', '{"a":2}', [], None),
    "2": ('{"c":3,"a":1}', '{"a":1,"b":2,"c":3}', [("b", "2")], '{"a":1,"b":2,"c":3}'),
    "3": ('{"x":0,"a":1}', '{"b":2,"a":1}', [("b", "2")], '{"b":2,"a":1,"x":0}'),
    "4": ("{}", '{"a":{"b":{"c":1}}}', [("a", '{"b":{"c":1}}')], '{"a":{"b":{"c":1}}}'),
    "5": ('{"a":5}', '{"a":{"p":{"q":1}}}', [("a>p", '{"q":1}')], '{"a":{"p":{"q":1}}}'),
    "6": ('{"a":null}', '{"a":{"m":1}}', [("a>m", "1")], '{"a":{"m":1}}'),
    "7": ('{"a":[1]}', '{"a":[1,2,{"z":1}]}', [], None),
    "8": ("{}", '{"n":null}', [("n", "null")], '{"n":null}'),
    "9": (
        '{"z":{"k":1},"y":1}',
        '{"y":1,"z":{"j":0,"k":1}}',
        [("z>j", "0")],
        '{"z":{"j":0,"k":1},"y":1}',
    ),
    "10": (
        "{}",
        '{"b":1,"10":2,"2":3}',
        [("2", "3"), ("10", "2"), ("b", "1")],
        '{"2":3,"10":2,"b":1}',
    ),
    "11": ('{"a":{}}', '{"a":{}}', [], None),
    "12": ("{}", '{"a":1,"a":2}', [("a", "2")], '{"a":2}'),
    "12a": (
        "{}",
        '{"a":1,"b":2,"a":{"q":9}}',
        [("a", '{"q":9}'), ("b", "2")],
        '{"a":{"q":9},"b":2}',
    ),
    "12b": (
        '{"a":{}}',
        '{"x":0,"a":{"b":1},"10":1,"9":1}',
        [("9", "1"), ("10", "1"), ("x", "0"), ("a>b", "1")],
        '{"9":1,"10":1,"x":0,"a":{"b":1}}',
    ),
    "13": ("{bad", '{"a":1}', [], None),
    "13a": ('{"a":1} x', '{"b":1}', [], None),
    "14": ("", '{"a":1}', [], None),
    "14a": (" \t ﻿\n", '{"a":1}', [], None),
    "15": ('{"a":1}', "[1,2]", [], None),
    "16": ("null", '{"a":1}', [], None),
    "16a": ("-0.0e3", '{"a":1}', [], None),
    "17": ("5", '{"a":1}', [], None),
    "18": ("{}", '{"toString":1}', [("toString", "1")], '{"toString":1}'),
    "19": ('{"a":"xy"}', '{"a":{"b":1}}', [("a>b", "1")], '{"a":{"b":1}}'),
    # Values are never compared, arrays on the target side have their indexes as keys.
    "20": ('{"a":[7]}', '{"a":{"b":[]}}', [("a>b", "[]")], '{"a":{"0":7,"b":[]}}'),
    "20a": ('{"a":[7,{"x":1}]}', '{"a":{"1":{"y":2},"b":1}}', [("a>1>y", "2"), ("a>b", "1")],
            '{"a":{"0":7,"1":{"y":2,"x":1},"b":1}}'),
    "21": ('{"a":[7]}', '{"a":{}}', [], None),
    # An empty object is no reason to replace a scalar.
    "22": ('{"a":5,"b":1}', '{"a":{},"c":1}', [("c", "1")], '{"a":5,"c":1,"b":1}'),
    # Odd keys, escapes, whitespace, numbers as a script engine prints them.
    "23": (
        ' { "" : {"a.b":1} } ',
        '\n{"":{"a.b":2,"x > y":3,"q\\"\\\\":"\\u001F\\u0041\\n"},"s":"null"}\n',
        [(">x > y", "3"), ('>q"\\', '"\\u001fA\\n"'), ("s", '"null"')],
        '{"":{"a.b":1,"x > y":3,"q\\"\\\\":"\\u001fA\\n"},"s":"null"}',
    ),
    "24": (
        "{}",
        '{"n":[1.0,1e3,0.00010,1e-7,1.5E300,12345678901234567890,-0,1e21,123e18,-12.50,true,null]}',
        [
            (
                "n",
                "[1,1000,0.0001,1e-7,1.5e+300,12345678901234567000,0,1e+21,"
                "123000000000000000000,-12.5,true,null]",
            )
        ],
        '{"n":[1,1000,0.0001,1e-7,1.5e+300,12345678901234567000,0,1e+21,'
        "123000000000000000000,-12.5,true,null]}",
    ),
    # Nested repeats and index keys inside a taken-over value are put in order as well.
    "25": (
        "{}",
        '{"o":{"z":1,"7":{"b":1,"b":{"2":0,"1":0}},"z":"s"},"p":["s1",{"t":"\\"s"}]}',
        [
            ("o", '{"7":{"b":{"1":0,"2":0}},"z":"s"}'),
            ("p", '["s1",{"t":"\\"s"}]'),
        ],
        '{"o":{"7":{"b":{"1":0,"2":0}},"z":"s"},"p":["s1",{"t":"\\"s"}]}',
    ),
    "26": (
        '{"b":{"y":1},"4294967295":0,"3":0}',
        '{"4294967295":1,"b":{"x":{"k":[[],{}]},"y":2},"4294967294":9,"01":5}',
        [("4294967294", "9"), ("b>x", '{"k":[[],{}]}'), ("01", "5")],
        '{"3":0,"4294967294":9,"4294967295":0,"b":{"x":{"k":[[],{}]},"y":1},"01":5}',
    ),
    "27": ("[1]", '{"a":1,"0":5}', [("a", "1")], '{"0":1,"a":1}'),
    "28": ('{"a":{"b":null}}', '{"a":{"b":null,"b":{"c":"s"}}}', [("a>b>c", '"s"')],
           '{"a":{"b":{"c":"s"}}}'),
}
