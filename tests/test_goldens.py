"""Published result values reproduced from their published inputs."""

import math

import pytest
from pyspark.sql import functions as F

from tidewright.operators import joins as J
from tidewright.operators import onset as O
from tidewright.operators import skill as K

# The first observed and modelled 14-day means of a published pair table.
PAIRS = [
    (5.25830427045, 4.52649312935808),
    (6.730155619515, 3.7991571386651524),
    (3.8534882872500003, 3.1059938994075207),
    (4.1887812554625, 3.052857286242134),
    (4.358692447875, 2.5193647509970747),
    (3.664210935346875, 2.1134561592866206),
    (3.587297957099999, 1.9143190785124808),
    (2.423324991853125, 1.6378203606783601),
    (2.43107726259375, 1.7546046751949602),
]

# Published onset days of 2003 to 2016 from satellite data, with their labels, and from the grid and series models.
SATELLITE = dict(zip(range(2003, 2017), [100, 68, 50, 83, 115, 115, 100, 100, 92, 88, 92, 92, 55, 77]))
SATELLITE_LABELS = dict(zip(range(2003, 2017), ["avg", "avg", "early", "avg", "late", "late", "avg", "avg", "avg", "avg", "avg", "avg", "early", "avg"]))
GRID_ONSET = dict(zip(range(2003, 2017), [95, 95, 59, 101, 101, 110, 95, 86, 104, 101, 83, 80, 59, 77]))
SERIES_ONSET = dict(zip(range(2003, 2017), [83, 74, 71, 89, 92, 95, 92, 68, 98, 95, 77, 74, 53, 77]))

# Published yearly spring anomalies, observed and modelled.
SPRING_OBS = [1.3382570669952667, 0.03619663704141163, -0.5198371364031994, -0.5151928690494392, -0.4433667136437812, -0.5792180124447762,
              -0.45031028574314635, 0.5314668552739968, -0.9974320812711943, -0.1441574897957676, 1.2678009345472034, -0.37988118442663493,
              -0.8804163524615394, 0.24589947423118566, 0.16442588628985683, -0.2862249367934707, 0.28799132689023593]
SPRING_MODEL = [1.331963307007757, -0.8913809865553046, -1.3695741338042866, -0.04961928499169687, -0.5834454795365076, -0.12099079537271684,
                -0.36426754540081585, 0.3589498256342114, -0.811623256756854, 0.041221083779429846, 0.7472019802820989, -1.0283207396334704,
                -0.8666552015908916, 0.5990141118571062, 0.5216060350363041, -0.754100431553232, -0.23705315579223968]

# Published spring means of a long model run, and the onset days of the same years.
FULL_SPRING = [0.3580063312486751, 0.398762945547184, 0.3292805436548314, 0.4235717457474756, 0.3741359545455397, 0.36016172955275305,
               0.33237052136302775, 0.38433494823942865, 0.37058932912124914, 0.32565031851020904, 0.36992463415057625, 0.3210679758415811,
               0.46296883066411265, 0.361509478965633, 0.42075988202353654, 0.38553841053054, 0.33459222658386517, 0.3187605452235221,
               0.4277391131970044, 0.3313131827857288, 0.3841458524254369, 0.3779214398396242, 0.32117391716122096, 0.41441247277057897,
               0.4299086966224188, 0.41867021320940623, 0.3552622642571323, 0.33338772186739274, 0.32360781239060543, 0.3280638623477916,
               0.39199163297845163, 0.28974991032263603, 0.31943454217908557, 0.36992722590028354, 0.39162364551781786, 0.4612495495924563,
               0.46010039525476487, 0.29557353109643, 0.3648355948626374]
FULL_ONSET = [95, 71, 83, 74, 89, 77, 95, 83, 101, 95, 86, 101, 74, 86, 86, 89, 86, 95, 77, 95, 86, 86, 98, 92, 74, 59, 95, 95, 107, 83, 68, 95, 83, 77,
              74, 56, 68, 98, 80]


def frame(spark, a, b):
    return spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "o double, m double")


def test_spring_total_performance(spark):
    r = K.skill(frame(spark, SPRING_OBS, SPRING_MODEL), [], "o", "m", which="classic", standardised=True).first()
    want = dict(n=17, bias=-0.12665151686043033, mae=0.37430879648451104, rmse=0.4584779636319775, nrmse=0.4584779636319775,
                r=0.7935264357938093, r2=0.6296842043036266, mape=238.0196225796451, nse=0.4921836683414226, wss=0.8767843852198234)
    for k, v in want.items():
        assert r[k] == pytest.approx(v, rel=1e-9), k


def test_timing_statistics(spark):
    for onset, want in ((GRID_ONSET, (12.41, 10.5, 153.93, 1.36, 0.76, 0.86, 18.93, 15.3)), (SERIES_ONSET, (15.71, 12.93, 246.93, -6.36, 0.65, 0.75, 18.93, 12.46))):
        d = frame(spark, SATELLITE.values(), [onset[y] for y in SATELLITE])
        r = K.skill(d, [], "o", "m", which="timing").first()
        got = (r.rmse, r.mae, r.mse, r.bias, r.r, r.wss_floor, r.obs_std_pop, r.model_std_pop)
        assert [round(x, 2) for x in got] == list(want)


@pytest.mark.parametrize("onset,agree,overlap", [(GRID_ONSET, 13, 5), (SERIES_ONSET, 10, 2)])
def test_agreement_and_overlap(spark, onset, agree, overlap):
    o = spark.createDataFrame([(y, d, SATELLITE_LABELS[y]) for y, d in SATELLITE.items()], "year int, od int, ol string")
    m = spark.createDataFrame(list(onset.items()), "year int, md int").withColumn("ml", O.labels_by_bounds(F.col("md"), 68, 108))
    a = O.agreement(o, m, ["year"], "ol", "ml").first()
    assert (a["count"], a.total) == (agree, 14) and math.isclose(a.proportion, agree / 14)
    assert J.window_overlap(o, m, ["year"], "od", "md").where("overlap").count() == overlap


def test_phenology_link(spark):
    r = K.correlation(frame(spark, FULL_ONSET, FULL_SPRING), [], "o", "m").first()
    assert r.n == 39
    assert r.r == pytest.approx(-0.7332201671109753, rel=1e-9)
    assert r.lo == pytest.approx(-0.8517032637665882, rel=1e-9)
    assert r.hi == pytest.approx(-0.5434154859556493, rel=1e-9)
    assert r.p == pytest.approx(1.1045156270808188e-07, rel=1e-6)


def test_pairs_excerpt_against_plain_formulas(spark):
    import numpy as np

    o, m = np.array(PAIRS).T
    r = K.skill(frame(spark, o, m), [], "o", "m", which="paired").first()
    wss = 1 - ((m - o) ** 2).sum() / ((abs(m - o.mean()) + abs(o - o.mean())) ** 2).sum()
    assert r.wss == pytest.approx(wss) and r.obs_std == pytest.approx(o.std(ddof=1)) and r.r == pytest.approx(np.corrcoef(o, m)[0, 1])
