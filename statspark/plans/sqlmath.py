"""SQL text for the tail probabilities, used by the SQL twins (the engine there has no erf or beta)."""


def q_gamma(a: str, x: str, terms: int = 600) -> str:
    """Regularised upper gamma by its all-positive lower series in log space."""
    body = f"exp((i_ + ({a})) * ln({x}) - ({x}) - lgamma(({a}) + i_ + 1))"
    series = f"list_sum(list_transform(range(0, {terms}), lambda i_: {body}))"
    return f"(CASE WHEN ({x}) IS NULL THEN NULL WHEN ({x}) <= 0 THEN 1.0 WHEN ({x}) > {terms // 2} THEN 0.0 ELSE 1 - {series} END)"


def chi2_p(x: str, dof: str) -> str:
    return q_gamma(f"({dof}) / 2.0", f"({x}) / 2.0")


def norm_p2(z: str) -> str:
    return q_gamma("0.5", f"({z}) * ({z}) / 2.0")


def norm_cdf(z: str, terms: int = 150) -> str:
    tail = q_gamma("0.5", f"({z}) * ({z}) / 2.0", terms)
    return f"(CASE WHEN ({z}) < 0 THEN {tail} / 2 ELSE 1 - {tail} / 2 END)"


def i_beta(a: str, b: str, x: str, terms: int = 600) -> str:
    body = (
        f"exp((({a}) + i_) * ln({x}) + ({b}) * ln(1 - ({x})) + lgamma(({a}) + ({b}) + i_) - lgamma({b}) "
        f"- lgamma(({a}) + 1 + i_))"
    )
    return (
        f"(CASE WHEN ({x}) <= 0 THEN 0.0 ELSE "
        f"list_sum(list_transform(range(0, {terms}), lambda i_: {body})) END)"
    )


def f_p(f: str, d1: str, d2: str) -> str:
    x = f"(({d1}) * ({f}) / (({d1}) * ({f}) + ({d2})))"
    return (
        f"(CASE WHEN ({f}) IS NULL THEN NULL WHEN ({d1}) * ({f}) > 600 THEN 0.0 "
        f"ELSE 1 - {i_beta(f'({d1}) / 2.0', f'({d2}) / 2.0', x)} END)"
    )


def t_p2(t: str, dof: str) -> str:
    return f_p(f"({t}) * ({t})", "1.0", dof)
