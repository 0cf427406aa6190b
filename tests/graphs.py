"""The mini code graph of the fixtures."""

from lattice import schema
from lattice.operators.graph import Graph


def mini(spark):
    f = [("alpha", "src/app.ts", "typescript", 120), ("alpha", "src/lib/util.ts", "typescript", 40), ("beta", "api/main.py", "python", 80), ("beta", "api/models.py", "python", 60)]
    s = [("alpha", "src/app.ts", "App", "class", 10), ("alpha", "src/app.ts", "render", "function", 30), ("alpha", "src/lib/util.ts", "fmt", "function", 5), ("beta", "api/models.py", "Base", "class", 3),
         ("beta", "api/models.py", "UserCreate", "class", 10), ("beta", "api/models.py", "UserRead", "class", 20), ("beta", "api/main.py", "main", "function", 7)]
    app, util, main, models = (f"{p}|{x}" for p, x, _, _ in f)
    node = {
        "Project": [(p, p, "", "", "active", False, "") for p in ("alpha", "beta")],
        "File": [(f"{p}|{x}", x, p, lang, n) for p, x, lang, n in f],
        "Symbol": [(f"{p}|{x}|{n}", n, p, x, k, line) for p, x, n, k, line in s],
        "Package": [("react", "react", None, "npm"), ("zod", "zod", None, "npm"), ("fastapi", "fastapi", None, "pip")],
        "Session": [(i, i, p, "", t, "", 0, 0, 0, "", "", "") for i, p, t in (("s1", "alpha", "2026-01-01T10:00:00Z"), ("s2", "alpha", "2026-01-02T09:00:00Z"), ("s3", "beta", "2026-01-03T08:00:00Z"))],
    }
    mod = lambda x, a, r: (x, x, "Ann", "2026-01-01", a, r, "01234567")
    edge = {
        ("Project", "HAS_FILE", "File"): [(p, f"{p}|{x}") for p, x, _, _ in f],
        ("File", "DEFINES", "Symbol"): [(f"{p}|{x}", f"{p}|{x}|{n}") for p, x, n, _, _ in s],
        ("Project", "DEPENDS_ON", "Package"): [("alpha", "react"), ("alpha", "zod"), ("beta", "react"), ("beta", "fastapi")],
        ("File", "MODIFIED", "File"): [mod(app, 10, 2), mod(app, 5, 1), mod(util, 3, 0)],
        ("File", "IMPORTS", "File"): [(app, util), (main, models)],
        ("File", "IMPORTS", "Package"): [(app, "react"), (main, "fastapi")],
        ("File", "CALLS", "Symbol"): [(app, f"{util}|fmt"), (main, f"{models}|UserCreate")],
        ("Symbol", "INHERITS", "Symbol"): [(f"{models}|UserCreate", f"{models}|Base"), (f"{models}|UserRead", f"{models}|Base")],
        ("Session", "TOUCHED", "File"): [("s1", util, 1), ("s3", main, 2)],
        ("Session", "EDITED", "File"): [("s1", app, 4), ("s2", app, 2)],
        ("Session", "CREATED", "File"): [("s2", util, 1)],
        ("Session", "IN_PROJECT", "Project"): [("s1", "alpha"), ("s2", "alpha"), ("s3", "beta")],
    }
    return Graph(spark, {k: spark.createDataFrame(v, schema.NODES[k]) for k, v in node.items()}, {k: spark.createDataFrame(v, schema.EDGES[k]) for k, v in edge.items()})
