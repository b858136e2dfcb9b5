"""Building blocks of the SQL that checks the catalogue: plain definitions, independent of the operators."""

from __future__ import annotations

from lesionlens.functions.fixed import SEED
from lesionlens.operators.resample import CHUNK, MODULUS, ROUTE, SECOND_SALT, STEP
from lesionlens.plans.fixtures import ansi

CODE = "(cast({z} as bigint) * 1099511627776 + cast({y} as bigint) * 1048576 + {x})"


def code(z: str = "z", y: str = "y", x: str = "x") -> str:
    return CODE.format(z=z, y=y, x=x)


def with_(*ctes: tuple[str, str], recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}" + ", ".join(
        f"{n} as {'' if 'union select r.k' in q else 'materialized '}({q})" for n, q in ctes
    ) + "\n"


# Simpson's rule over 4,000 steps: tails are integrals of their densities here, continued fractions in the operators
GRID = ("grid", "select i / 4000.0e0 as u, case when i in (0, 4000) then 1.0e0 when i % 2 = 1 then 4.0e0 else 2.0e0 end / 12000.0e0 as w "
                "from (select unnest(range(0, 4001)) as i) t")


def correlation_p(r: str, dof: str) -> str:
    """Two-sided p of a correlation: the density of the angle whose sine is r."""
    angle, nu = f"asin(least(abs({r}), 1.0e0))", f"({dof})"
    length = f"least(pi() / 2 - {angle}, 60.0e0 / ({nu} * tan({angle}) + sqrt({nu})))"
    return (f"(select sum(w * pow(greatest(cos({angle} + {length} * u), 0), {nu} - 1)) * {length} from grid)"
            f" * 2 * exp(lgamma(({nu} + 1) / 2.0e0) - lgamma({nu} / 2.0e0)) / sqrt(pi())")


def normal_p(z: str) -> str:
    length = f"(40.0e0 / ({z} + 3))"
    return f"(select sum(w * exp(-0.5e0 * pow({z} + {length} * u, 2))) * {length} from grid) * 2 / sqrt(2 * pi())"


def digits(p: str) -> str:
    """log10 of a p value to six digits; values that doubles barely hold are left out."""
    return f"case when {p} > 1e-290 then round(log10({p}), 6) end"


def fx(name: str) -> tuple[str, str]:
    return (name, ansi(name))


STEPS = "(select unnest([-1, 0, 1]) as d)"
NEIGHBOURS = (
    "select a.d as dz, b.d as dy, c.d as dx from {0} a, {0} b, {0} c".format(STEPS)
)


def component_ctes(mask: str, prefix: str = "") -> list[tuple[str, str]]:
    """CTEs giving {prefix}comp(k, case_id, id, comp) of a mask CTE with (k, case_id, z, y, x).

    Every voxel spreads its id to larger ids it can reach; the smallest id to arrive names the component.
    """
    p = prefix
    return [
        (f"{p}node", f"select k, case_id, z, y, x, {code()} as id from {mask}"),
        (f"{p}step", NEIGHBOURS),
        (f"{p}moved", f"""select k, case_id, id, z + dz as z, y + dy as y, x + dx as x from {p}node cross join {p}step
            where dz <> 0 or dy <> 0 or dx <> 0"""),
        (f"{p}edge", f"""select a.k, a.case_id, a.id as u, b.id as w from {p}moved a join {p}node b
            on b.k = a.k and b.case_id = a.case_id and b.z = a.z and b.y = a.y and b.x = a.x"""),
        (f"{p}reach", f"""select k, case_id, id as root, id as node from {p}node
            union select r.k, r.case_id, r.root, e.w from {p}reach r
            join {p}edge e on e.k = r.k and e.case_id = r.case_id and e.u = r.node where e.w > r.root"""),
        (f"{p}comp", f"select k, case_id, node as id, min(root) as comp from {p}reach group by 1, 2, 3"),
    ]


def hashed(salt: str | int, i: str = "i") -> str:
    h1 = f"((b * 7919 + {i} * 104729 + {salt}) % {MODULUS})"
    h2 = f"(({h1} * {h1} + 12345) % {MODULUS})"
    return f"(({h2} * 48271 + b) % {MODULUS})"


def drawn_ctes(rows: str, by: list[str], order: str, replicates: int, salt: int = SEED, prefix: str = "", size: int = CHUNK) -> list[tuple[str, str]]:
    """CTEs giving {prefix}ord(rows with i from 1 and n) and {prefix}drawn(n, b, d): the rows d that replicate b of a group of n draws."""
    p, part = prefix, f"partition by {', '.join(by)}" if by else ""
    route = f"({hashed(salt + ROUTE[0])} * {MODULUS} + {hashed(salt + ROUTE[1])}) % n // {size}"
    sizes = f"(select distinct n from {p}ord) q, (select unnest(range(1, {replicates + 1})) as b) r"
    return [
        (f"{p}ord", f"select *, row_number() over ({part} order by {order}) as i, count(*) over ({part}) as n from {rows}"),
        (f"{p}route", f"""select n, b, 0 as c, n as m from {sizes} where n <= {size}
          union all select n, b, {route} as c, count(*) as m from (select n, b, unnest(range(1, n + 1)) as i from {sizes} where n > {size}) x group by all"""),
        (f"{p}sent", f"select n, b, c, unnest(range(1, m + 1)) as j from {p}route"),
        (f"{p}drawn", f"select n, b, c * {size} + 1 + {hashed(f'{salt} + c * {STEP}', 'j')} % least({size}, n - c * {size}) as d from {p}sent"),
    ]


def bootstrap_ctes(
    rows: str, by: list[str], values: list[str], order: str, replicates: int, salt: int = SEED, prefix: str = "", size: int = CHUNK
) -> list[tuple[str, str]]:
    """CTEs giving {prefix}rep(by, b, mean_<v>) from a CTE ``rows``."""
    p, keys = prefix, "".join(f"{c}, " for c in by)
    means = ", ".join(f"avg(o.{v}) as mean_{v}" for v in values)
    return [
        *drawn_ctes(rows, by, order, replicates, salt, prefix, size),
        (f"{p}rep", f"select {keys} b, {means} from {p}drawn d join {p}ord o on o.n = d.n and o.i = d.d group by {keys} b"),
    ]


def interval(value: str, digits: int = 9) -> str:
    return (
        f"round(quantile_cont({value}, 0.025), {digits}) as ci_low, round(quantile_cont({value}, 0.975), {digits}) as ci_high"
    )


SALT2 = SEED + SECOND_SALT
