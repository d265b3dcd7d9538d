from promspark.functions.distributions import chi2_sf, normal_two_sided_p, t_two_sided_p


def test_t_table_values():
    # published two-sided 5 % critical values
    assert abs(t_two_sided_p(2.228, 10) - 0.05) < 2e-4
    assert abs(t_two_sided_p(1.960, 1e6) - 0.05) < 2e-4
    assert abs(t_two_sided_p(12.706, 1) - 0.05) < 2e-4
    assert abs(t_two_sided_p(0.0, 5) - 1.0) < 1e-12


def test_chi2_table_values():
    assert abs(chi2_sf(3.841, 1) - 0.05) < 2e-4
    assert abs(chi2_sf(5.991, 2) - 0.05) < 2e-4
    assert abs(chi2_sf(6.635, 1) - 0.01) < 2e-4


def test_normal():
    assert abs(normal_two_sided_p(1.959964) - 0.05) < 1e-6


def test_t_tail_with_very_many_degrees_of_freedom():
    """At 1e8 and more degrees of freedom the t tail is the normal one to a relative error of about t**4 / df."""
    import math

    from promspark.functions.distributions import t_two_sided_p
    for df in (1e8, 1e10, 1e12, 1e13, 1e15):
        for t in (0.1, 1.0, 2.5, 6.0):
            want = math.erfc(t / math.sqrt(2))
            assert abs(t_two_sided_p(t, df) / want - 1) < 1e-8 + t ** 4 / df


def test_both_forms_of_the_t_tail_agree(monkeypatch):
    from promspark.functions import distributions as D
    for t in (0.01, 0.5, 2.0, 6.0, 12.0):
        large = D.t_two_sided_p(t, 1e6)
        monkeypatch.setattr(D, "LARGE_DF", 1e9)
        assert abs(D.t_two_sided_p(t, 1e6) / large - 1) < 1e-8
        monkeypatch.setattr(D, "LARGE_DF", 1e6)
