"""Normal distribution as Column expressions.

The quantile is Wichura's AS 241 (PPND16).  The distribution function is
Cody's rational erfc approximation (1969).  Both are within about 1e-15 of the
exact value, need no Python worker and stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients as published in AS 241.
_CENTRE_NUM = (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427,
               13731.693765509461125, 45921.953931549871457, 67265.770927008700853,
               33430.575583588128105, 2509.0809287301226727)
_CENTRE_DEN = (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077,
               21213.794301586595867, 39307.895800092710610, 28729.085735721942674,
               5226.4952788528545610)
_NEAR_NUM = (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550,
             3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770,
             0.0227238449892691845833, 0.000774545014278341407640)
_NEAR_DEN = (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550,
             0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600,
             1.05075007164441684324e-9)
_FAR_NUM = (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580,
            0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860,
            2.71155556874348757815e-5, 2.01033439929228813265e-7)
_FAR_DEN = (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525,
            0.000786869131145613259100, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
            2.04426310338993978564e-15)

# Cody's coefficients for erf on |x| <= 0.46875 and erfc above.
_ERF_NUM = (3209.37758913846947, 377.485237685302021, 113.864154151050156, 3.16112374387056560,
            0.185777706184603153)
_ERF_DEN = (2844.23683343917062, 1282.61652607737228, 244.024637934444173, 23.6012909523441209, 1.0)
_MID_NUM = (1230.33935479799725, 2051.07837782607147, 1712.04761263407058, 881.952221241769090,
            298.635138197400131, 66.1191906371416295, 8.88314979438837594, 0.564188496988670089,
            2.15311535474403846e-8)
_MID_DEN = (1230.33935480374942, 3439.36767414372164, 4362.61909014324716, 3290.79923573345963,
            1621.38957456669019, 537.181101862009858, 117.693950891312499, 15.7449261107098347, 1.0)
_TAIL_NUM = (6.58749161529837803e-4, 0.0160837851487422766, 0.125781726111229246, 0.360344899949804439,
             0.305326634961232344, 0.0163153871373020978)
_TAIL_DEN = (0.00233520497626869185, 0.0605183413124413191, 0.527905102951428412, 1.87295284992346047,
             2.56852019228982242, 1.0)
_INV_SQRT_PI = 0.5641895835477562869


def _poly(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[-1])
    for value in reversed(coefficients[:-1]):
        out = out * x + F.lit(value)
    return out


def _ratio(num, den, x: Column) -> Column:
    return _poly(num, x) / _poly(den, x)


def let(x: Column, body) -> Column:
    """``body(x)`` with x evaluated once, however often the body reads it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def norm_ppf(p: Column) -> Column:
    """Quantile of the standard normal; null outside (0, 1)."""
    return let(p, _quantile)


def _quantile(p: Column) -> Column:
    q = p - F.lit(0.5)
    centre = q * let(F.lit(0.180625) - q * q, lambda u: _ratio(_CENTRE_NUM, _CENTRE_DEN, u))
    tail = F.sqrt(-F.ln(F.when(q < 0, p).otherwise(F.lit(1.0) - p)))
    size = let(tail, lambda r: F.when(r <= 5.0, _ratio(_NEAR_NUM, _NEAR_DEN, r - F.lit(1.6))).otherwise(
        _ratio(_FAR_NUM, _FAR_DEN, r - F.lit(5.0))))
    signed = F.when(q < 0, -size).otherwise(size)
    inside = (p > 0) & (p < 1)
    return F.when(inside & (F.abs(q) <= 0.425), centre).when(inside, signed)


def norm_cdf(x: Column) -> Column:
    """Distribution function of the standard normal."""
    return let(x, lambda v: let(_erfc(v), lambda e: F.when(v > 0, F.lit(1.0) - e * 0.5).otherwise(e * 0.5)))


def _erfc(x: Column) -> Column:
    def tail(z):
        inv = F.lit(1.0) / F.greatest(z * z, F.lit(1.0))
        series = let(inv, lambda i: F.lit(_INV_SQRT_PI) - i * _ratio(_TAIL_NUM, _TAIL_DEN, i))
        return F.exp(-z * z) / F.greatest(z, F.lit(1.0)) * series
    return let(F.abs(x) / F.lit(2.0 ** 0.5), lambda z: F.when(
        z <= 0.46875, F.lit(1.0) - z * _ratio(_ERF_NUM, _ERF_DEN, z * z)).when(
        z <= 4.0, F.exp(-z * z) * _ratio(_MID_NUM, _MID_DEN, z)).otherwise(tail(z)))
