"""A small graph of ships, their ports, firms and crews, as lines of files and as Python values to reckon with."""

#: (head, relation, tail) in file order; s1 calls at Hamburg twice, port 3 lies beside itself.
TRIPLES = [
    ("ship.s1", "calls_at", "port.1"), ("ship.s1", "calls_at", "port.1"), ("ship.s1", "calls_at", "port.2"), ("ship.s2", "calls_at", "port.2"), ("ship.s3", "calls_at", "port.3"), ("ship.s4", "calls_at", "port.3"),
    ("ship.s5", "calls_at", "port.1"), ("ship.s1", "run_by", "firm.Nordsee"), ("ship.s2", "run_by", "firm.Nordsee"), ("ship.s3", "run_by", "firm.Adria"), ("ship.s4", "run_by", "firm.Adria"),
    ("ship.s5", "run_by", "firm.Baltia"), ("firm.Adria", "part_of", "firm.Nordsee"), ("port.1", "beside", "port.2"), ("port.3", "beside", "port.3"),
]
#: (sailor, ship, how long)
CREWS = [("sailor.1", "ship.s1", 5), ("sailor.1", "ship.s2", 3), ("sailor.2", "ship.s2", 4), ("sailor.2", "ship.s3", 5), ("sailor.3", "ship.s1", 2), ("sailor.3", "ship.s5", 4), ("sailor.4", "ship.s4", 1)]
#: id -> name, tons, built; s4's line ends behind its id
SHIPS = {"s1": ("Aurora", 1200.5, 1988), "s2": ("Borealis", 800.0, 1988), "s3": ("Corona", 450.25, 2003), "s4": (None, None, None), "s5": ("Aurelia", 90.0, 2011)}
#: id -> title, depth
PORTS = {1: ("Hamburg", 15), 2: ("Bremen", 11), 3: ("Split", 9)}
FIRMS = ["Nordsee", "Adria", "Baltia"]
SAILORS = [1, 2, 3, 4]

FILES = {
    "h.kg": ["\t".join(t) for t in TRIPLES] + ["short\tline"],
    "h.ui": [f"{a}\t{b}\t{n}" for a, b, n in CREWS],
    "h.ship": ["id\tname\ttons\tbuilt", *("\t".join([k, *map(str, v)]) if v[0] else k for k, v in SHIPS.items())],
    "h.port": ["id\ttitle\tdepth", *(f"{k}\t{t}\t{d}" for k, (t, d) in PORTS.items())],
}


def tails(relation, head=None):
    return [t.split(".")[1] for h, r, t in TRIPLES if r == relation and head in (None, h)]


def heads(relation, tail):
    return [h.split(".")[1] for h, r, t in TRIPLES if r == relation and t == tail]


def firm_of(ship):
    return tails("run_by", f"ship.{ship}")[0]


def crew(ship):
    return [int(a.split(".")[1]) for a, b, _ in CREWS if b == f"ship.{ship}"]
