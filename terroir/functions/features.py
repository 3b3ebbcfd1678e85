"""Column expressions for engineered features and scores (all JVM-side, codegen'd)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources import knowledge as K


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dlit(x: float) -> Column:
    """A DOUBLE literal (never a decimal literal: keeps IEEE arithmetic on both engines)."""
    return F.lit(float(x))


# F1
def fertility_score(n="N", p="P", k="K") -> Column:
    return (col(n) + col(p) + col(k)) / dlit(3)


# F2
def soil_quality_index(n="N", p="P", k="K", oc="organic_carbon", ph="ph") -> Column:
    return (dlit(0.3) * col(n) + dlit(0.25) * col(p) + dlit(0.25) * col(k) + dlit(0.1) * col(oc)
            - dlit(0.1) * F.abs(col(ph) - dlit(6.5)))


# F3 (Q20: the weights already sum to 100, so the x100 clips almost every row; rescale=True drops it)
def soil_health_score(n="N", p="P", k="K", oc="organic_carbon", ph="ph", moisture="moisture",
                      rescale: bool = False) -> Column:
    raw = (col(n) / dlit(200) * dlit(25) + col(p) / dlit(200) * dlit(20) + col(k) / dlit(200) * dlit(20)
           + col(oc) / dlit(5) * dlit(15) + (dlit(1) - F.abs(col(ph) - dlit(6.5)) / dlit(7)) * dlit(10)
           + col(moisture) / dlit(100) * dlit(10))
    if not rescale:
        raw = raw * dlit(100)
    return F.round(F.least(F.greatest(raw, dlit(0)), dlit(100)), 1)


# F5
def season_code(season="season") -> Column:
    s = F.lower(F.trim(col(season).cast("string")))
    expr = F.lit(0)
    for i, name in reversed(list(enumerate(K.SEASONS))):
        expr = F.when(s == name, F.lit(i)).otherwise(expr)
    return expr


# F6
def nutrient_status(n="N", p="P", k="K") -> Column:
    t = K.DEFICIENCY_THRESHOLDS
    return (F.when(col(n) < dlit(t["N"]), "Nitrogen deficient")
            .when(col(p) < dlit(t["P"]), "Phosphorus deficient")
            .when(col(k) < dlit(t["K"]), "Potassium deficient")
            .otherwise("Balanced"))


def nutrient_status_code(n="N", p="P", k="K") -> Column:
    t = K.DEFICIENCY_THRESHOLDS
    return (F.when(col(n) < dlit(t["N"]), 1).when(col(p) < dlit(t["P"]), 2)
            .when(col(k) < dlit(t["K"]), 3).otherwise(0))


# F10
def soil_health_rating(n="N", p="P", k="K", ph="ph") -> Column:
    phv = col(ph)
    ph_score = (F.when(phv.between(6.0, 7.5), 30)
                .when(((phv >= 5.0) & (phv < 6.0)) | ((phv > 7.5) & (phv <= 8.5)), 20)
                .otherwise(10))
    total = col(n) + col(p) + col(k)
    npk = F.when(total < 60.0, 30).when(total > 350.0, 40).otherwise(70)
    return ph_score + npk


# F11
def intelligence_score(ml_conf, env, graph, soil, penalties) -> Column:
    weighted = (dlit(0.35) * col(ml_conf) + dlit(0.30) * col(env) + dlit(0.20) * col(graph)
                + dlit(0.15) * col(soil))
    return F.greatest(F.lit(0), F.least(F.lit(100), (weighted - col(penalties)).cast("int")))


# F13
def alignment_score(user_temp, live_temp, user_hum, live_hum) -> Column:
    raw = dlit(100) - F.abs(col(user_temp) - col(live_temp)) * dlit(4.5) - F.abs(col(user_hum) - col(live_hum)) * dlit(1.2)
    return F.greatest(F.lit(5), F.least(F.lit(100), raw.cast("int")))


def alignment_tier(score) -> Column:
    s = col(score)
    return F.when(s >= 80, "HIGH CONSISTENCY").when(s >= 50, "MODERATE DIVERGENCE").otherwise("CRITICAL ANOMALY")


# F14
def grid_key(lat="lat", lon="lon") -> Column:
    return F.format_string("%.2f_%.2f", F.round(col(lat), 2), F.round(col(lon), 2))


# P9
def valid_coordinates(lat, lon) -> Column:
    la = col(lat).try_cast("double") if hasattr(Column, "try_cast") else F.expr(f"try_cast({lat} as double)")
    lo = col(lon).try_cast("double") if hasattr(Column, "try_cast") else F.expr(f"try_cast({lon} as double)")
    return F.coalesce(la.between(-90.0, 90.0) & lo.between(-180.0, 180.0), F.lit(False))
