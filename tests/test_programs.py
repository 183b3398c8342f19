"""Programs end to end, compared in order. Data: boats, their harbours, catches and berths."""

import datetime as dt

import pytest

from stepframe.functions import scalar
from stepframe.lang.parser import ParseError
from stepframe.plans import catalogue, catalogue_more  # noqa: F401

EPOCH = dt.date(1960, 1, 1)


def day(*ymd):
    return (dt.date(*ymd) - EPOCH).days


def lines(name, columns, *rows, lead=""):
    return f"data {name}; {lead} input {columns}; datalines;\n" + "\n".join(rows) + "\n;\nrun;\n"


BOATS = lines("boats", "boat $ crew port $", "Heron 4 Skagen", "Osprey 9 Esbjerg", "Tern 2 Skagen", "Gannet 6 Hanstholm", "Puffin 2 Esbjerg")
FLEET = [("Heron", 4, "Skagen"), ("Osprey", 9, "Esbjerg"), ("Tern", 2, "Skagen"), ("Gannet", 6, "Hanstholm"), ("Puffin", 2, "Esbjerg")]
CATCH = lines("catch", "boat $ kg", "Heron 120", "Heron 80", "Tern 40", "Osprey 300", "Osprey 10", "Osprey 25")


# --- reading


def test_lists_of_values(check):
    check(BOATS, boats=("boat crew port", FLEET))
    check(lines("t", "a b $ c", "1 x 2", ". y", "3 z 4.5"), t=("a b c", [(1, "x", 2), (None, "y", None), (3, "z", 4.5)]))


def test_fixed_columns(check):
    check(lines("t", "berth 1-2 keeper $ 4-15 depth 17-20", "07 Ida Holm     3.25", "11 Bo           12"), t=("berth keeper depth", [(7, "Ida Holm", 3.25), (11, "Bo", 12)]))


def test_informats_in_lists(check):
    check(
        lines("t", "boat $ value : comma12. built : date9. seen : mmddyy10.", "Heron 1,250,000 03MAR1998 12/31/2001", "Tern 900 29FEB2004 01/02/2003"),
        t=("boat value built seen", [("Heron", 1250000, day(1998, 3, 3), day(2001, 12, 31)), ("Tern", 900, day(2004, 2, 29), day(2003, 1, 2))]),
    )


def test_times_and_datetimes(check):
    check(lines("t", "left : time8. back : datetime20.", "06:05:30 02JAN1960:03:00:10"), t=("left back", [(21930, 86400 + 10810)]))
    check("data u; a = '23:59't; b = '01JAN1961:00:00:00'dt; c = '01JAN1961'd; run;", u=("a b c", [(86340, 366 * 86400, 366)]))


def test_records_of_several_lines(check):
    check(lines("t", "#1 boat $ crew #2 kg price", "Heron 4", "120 3.5", "Tern 2", "40 8"), t=("boat crew kg price", [("Heron", 4, 120, 3.5), ("Tern", 2, 40, 8)]))
    check(lines("t", "p #2 q @@", "5 6 7", "50 60 70"), t=("p q", [(5, 50), (6, 60), (7, 70)]))


def test_held_lines(check):
    check(lines("t", "kg day $ @@", "10 mon 20 tue", "30 wed 40 thu"), t=("kg day", [(10, "mon"), (20, "tue"), (30, "wed"), (40, "thu")]))
    check(
        "data t; input what $ @; if what = 'crew' then input crew; else input port $; datalines;\nport Skagen\ncrew 12\nport Thisted\n;\nrun;",
        t=("what crew port", [("port", None, "Skagen"), ("crew", 12, ""), ("port", None, "Thisted")]),
    )


def test_files_with_quotes_and_an_end(check, tmp_path):
    (tmp_path / "b.csv").write_text('boat,crew,note\nHeron,4,"fast, old"\nTern,,\n"Osprey ""II""",9,x\n')
    check(f'data t; infile "{tmp_path}/b.csv" dsd firstobs=2; input boat $ crew note $; run;', t=("boat crew note", [("Heron", 4, "fast, old"), ("Tern", None, ""), ('Osprey "II"', 9, "x")]))
    (tmp_path / "kg.txt").write_text("7\n11\n2\n")
    check(f'data u; infile "{tmp_path}/kg.txt" end=done; input kg; most = max(most, kg); retain most; days + 1; if done; keep most days; run;', u=("most days", [(11, 3)]))


# --- rows and state


def test_loops_and_arrays(check):
    check(
        lines("a", "m1 m2 m3", "3 5 7", "0 . 1") + "data b; set a; array m{3} m1-m3; big = 0; do k = 1 to 3; if m{k} > 2 then big = big + m{k}; end; drop k; run;"
        "data c; do n = 10 to 4 by -3; third = n / 3; output; end; run;"
        "data d; x = 1; steps = 0; do while (x < 50); x = x * 3; steps = steps + 1; end; do until (x < 60); x = x - 10; end; run;",
        b=("m1 m2 m3 big", [(3, 5, 7, 15), (0, None, 1, 0)]),
        c=("n third", [(10, 10 / 3), (7, 7 / 3), (4, 4 / 3)]),
        d=("x steps", [(51, 4)]),
    )


def test_row_numbers_and_totals(check):
    check(
        CATCH + "data t; set catch; row = _n_; total + kg; retain first 0; if _n_ = 1 then first = kg; run;",
        t=("total first boat kg row", [(120, 120, "Heron", 120, 1), (200, 120, "Heron", 80, 2), (240, 120, "Tern", 40, 3), (540, 120, "Osprey", 300, 4), (550, 120, "Osprey", 10, 5), (575, 120, "Osprey", 25, 6)]),
    )


def test_groups_of_rows(check):
    each = "if first.boat then do; kg_all = 0; trips = 0; end; kg_all + kg; trips + 1; if last.boat; keep boat kg_all trips; run;"
    check(CATCH + "proc sort data=catch; by boat; run; data g; set catch; by boat; " + each, g=("kg_all trips boat", [(200, 2, "Heron"), (335, 3, "Osprey"), (40, 1, "Tern")]))
    check(
        lines("x", "y m", "1 1", "1 1", "1 2", "2 2", "2 2", "1 2") + "data f; set x; by y m notsorted; a = first.y; b = last.y; c = first.m; d = last.m; run;".replace(" notsorted", ""),
        f=("y m a b c d", [(1, 1, 1, 0, 1, 0), (1, 1, 0, 0, 0, 1), (1, 2, 0, 1, 1, 1), (2, 2, 1, 0, 1, 0), (2, 2, 0, 1, 0, 1), (1, 2, 1, 1, 1, 1)]),
    )


def test_state_that_only_the_interpreter_keeps(check):
    check(
        CATCH + "proc sort data=catch; by boat; run; data g; set catch; by boat; retain low; if first.boat then low = kg; if kg < low then low = kg / 2; twice = low * 2; run;",
        g=("low boat kg twice", [(120, "Heron", 120, 240), (40, "Heron", 80, 80), (300, "Osprey", 300, 600), (5, "Osprey", 10, 10), (5, "Osprey", 25, 10), (40, "Tern", 40, 80)]),
    )


# --- options, filters, sets


def test_options_of_tables(check):
    check(
        BOATS + "data a; set boats(where=(crew < 5) rename=(port=home)); run; data b; set boats(firstobs=3 obs=4 keep=boat); run; data c(drop=port); set boats; if crew > 5; run;",
        a=("boat crew home", [("Heron", 4, "Skagen"), ("Tern", 2, "Skagen"), ("Puffin", 2, "Esbjerg")]),
        b=("boat", [("Tern",), ("Gannet",)]),
        c=("boat crew", [("Osprey", 9), ("Gannet", 6)]),
    )
    check(lines("w", "id d1 d2 d3 d4", "9 1 2 3 4") + "data k; set w; keep d2-d4; run; data r; set w; rename d1=monday d4=thursday; drop id d2; run;", k=("d2 d3 d4", [(2, 3, 4)]), r=("monday d3 thursday", [(1, 3, 4)]))


def test_missing_is_below_every_number(check):
    check(
        lines("t", "id v", "1 -5", "2 .", "3 8") + "data a; set t; where v < 0; run; data b; set t; if v > -9; run; data c; set t; q = 10 / (v - 8); s = v - 1; length = v = .; run;".replace("length", "gap"),
        a=("id v", [(1, -5), (2, None)]),
        b=("id v", [(1, -5), (3, 8)]),
        c=("id v q s gap", [(1, -5, 10 / -13, -6, 0), (2, None, None, None, 1), (3, 8, None, 7, 0)]),
    )


def test_stacked_and_appended(check):
    check("data p; kg = 5; run; data q; boat = 'Tern'; kg = 6; run; data pq; set p q p; run;", pq=("kg boat", [(5, ""), (6, "Tern"), (5, "")]))
    program = BOATS + "data late; boat = 'Skua'; crew = 3; flag = 1; run;\n"
    check(program + "proc append base=boats data=late force; run;", boats=("boat crew port", [*FLEET, ("Skua", 3, "")]))
    with pytest.raises(ValueError):
        check("proc append base=boats data=late; run;")


PORTS = lines("ports", "port $ depth", "Esbjerg 10", "Hirtshals 8", "Skagen 11")


def test_merge_by_key(check):
    # a source without a row of its own here holds its last values, and its IN= variable is 0
    check(
        BOATS + PORTS + "proc sort data=boats; by port; run; data m; merge boats(in=b) ports(in=p); by port; both = b and p; run; data none; merge boats(in=b) ports(in=p); by port; if p and not b; keep port depth; run;",
        m=("boat crew port depth both", [("Osprey", 9, "Esbjerg", 10, 1), ("Puffin", 2, "Esbjerg", 10, 0), ("Gannet", 6, "Hanstholm", None, 0), ("", None, "Hirtshals", 8, 0), ("Heron", 4, "Skagen", 11, 1), ("Tern", 2, "Skagen", 11, 0)]),
        none=("port depth", [("Hirtshals", 8)]),
    )


def test_merge_many_to_many_and_without_key(check):
    check(
        lines("x", "k a", "5 1", "5 2", "5 3", "6 4") + lines("y", "k b", "5 10", "5 20", "7 30") + "data m; merge x y(in=y); by k; f = first.k; l = last.k; has = y; run; data s; merge x(drop=k) y(drop=k); run;",
        m=("k a b f l has", [(5, 1, 10, 1, 0, 1), (5, 2, 20, 0, 0, 1), (5, 3, 20, 0, 1, 0), (6, 4, None, 1, 1, 0), (7, None, 30, 1, 1, 1)]),
        s=("a b", [(1, 10), (2, 20), (3, 30), (4, 30)]),
    )


def test_rows_to_several_tables(check):
    check(
        BOATS + "data small(keep=boat) busy; set boats; if crew < 3 then output small; else if crew > 5 then do; output busy; crew = 0; output busy; end; run;",
        small=("boat", [("Tern",), ("Puffin",)]),
        busy=("boat crew port", [("Osprey", 9, "Esbjerg"), ("Osprey", 0, "Esbjerg"), ("Gannet", 6, "Hanstholm"), ("Gannet", 0, "Hanstholm")]),
    )


def test_sorting_is_stable(check):
    check(BOATS + "proc sort data=boats out=s; by crew descending boat; run;", s=("boat crew port", [FLEET[2], FLEET[4], FLEET[0], FLEET[3], FLEET[1]]))
    check(lines("t", "v tag $", "3 a", ". b", "3 c", "1 d", ". e") + "proc sort data=t out=u nodupkey; by descending v; run;", u=("v tag", [(3, "a"), (1, "d"), (None, "b")]))


# --- functions


def test_calendar_functions(check):
    d = day(2016, 8, 17)
    check(
        f"""data t; d = {d}; y = year(d); m = month(d); dd = day(d); q = qtr(d); w = weekday(d); leap = mdy(2, 29, 2016); none = mdy(2, 29, 2015);
        noon = dhms(d, 12, 0, 5); back = datepart(noon); clock = timepart(noon); h = hms(2, 3, 4); run;""",
        t=("d y m dd q w leap none noon back clock h", [(d, 2016, 8, 17, 3, 4, day(2016, 2, 29), None, d * 86400 + 43205, d, 43205, 7384)]),
    )


def test_intervals(check):
    d = day(2016, 8, 17)
    noon = d * 86400 + 43205
    check(
        f"""data t; d = {d}; x = {noon}; a = intck('quarter', '31DEC2014'd, d); b = intck('week', '13AUG2016'd, '14AUG2016'd); c = intck('dthour', 0, 7200); e = intck('month3.2', '31JAN2016'd, '01FEB2016'd);
        f = intnx('year', d, -1, 'e'); g = intnx('qtr', d, 1, 'm'); h = intnx('months', d, 2, 's'); i = intnx('week.2', d, 0); j = intnx('dtday', x, 3, 's'); k = intnx('dtmonth', x, 0, 'e'); l = intnx('semiyear', d, 0); m = intnx('minute15', x, 1); drop d x; run;""",
        t=(
            "a b c e f g h i j k l m",
            [(7, 1, 2, 1, day(2015, 12, 31), (day(2016, 10, 1) + day(2016, 12, 31)) // 2, day(2016, 10, 17), day(2016, 8, 15), noon + 3 * 86400, day(2016, 8, 31) * 86400, day(2016, 7, 1), noon // 900 * 900 + 900)],
        ),
    )
    with pytest.raises(ValueError, match="fortnight"):
        check("data t; a = intck('fortnight', 0, 9); run;")


def test_text_functions(check):
    check(
        """data t; s = 'mackerel and Cod'; up = upcase(substr(s, 1, 4)); n = length('cod  '); p = propcase('north sea-coast'); c = cats('  a', 12, 'b '); x = catx('/', 'a', ' ', 'z'); at = index(s, 'and'); later = find(s, 'e', 6);
        one = scan(s, 2); last = scan(s, -1, ' '); k = compress('4-4 4', '-'); r = tranwrd(s, 'and', '&'); v = reverse('oar'); j = 1.5 || '|' || 2000000; blank = missing(trim('  ')); run;""",
        t=("s up n p c x at later one last k r v j blank", [("mackerel and Cod", "MACK", 3, "North Sea-coast", "a12b", "a/z", 10, 7, "and", "Cod", "44 4", "mackerel & Cod", "rao", "1.5|2e+06", 1)]),
    )


def test_number_functions(check):
    check(
        "data t; a = sum(., 4, 5); b = mean(2, ., 4); c = max(., -3); d = nmiss(., 1, .); e = round(7.125, .25); f = round(-2.5); g = int(-9.9); h = 3 ** 2 ** 0; i = -3 ** 2; j = not 1 or 2; l = log(-2); m = ceil(-1.5) + floor(-1.5); n = sqrt(49) + exp(0); run;",
        t=("a b c d e f g h i j l m n", [(9, 3, -3, 2, 7.25, -3, -9, 3, -9, 1, None, -3, 8)]),
    )


# --- formats


def test_value_formats_and_informats(check):
    check(
        """proc format;
  value tide low-<0='ebb' 0='slack' 0<-high='flood' other='unknown';
  value $grade 'A','B'='table' 'X'='bait' other='mixed';
  invalue points 'gold'=3 'silver'=2 other=0;
  invalue band low-5=1 6-high=2;
run;
""" + lines("t", "level mark $ medal $", "-1.5 B gold", "0 X tin", "2 Z silver", ". A x") + "data u; set t; a = put(level, tide.); b = put(mark, $grade.); c = input(medal, points.); e = input(put(level * -4, best8.), band.); drop level mark medal; run;",
        u=("a b c e", [("ebb", "table", 3, 2), ("slack", "bait", 0, 1), ("flood", "mixed", 2, 1), ("unknown", "table", 0, None)]),
    )


def test_pictures(check):
    check(
        """proc format; picture weight low-high='0,009.9 kg'; picture code other='99-999'; picture coin low-high='000,009.99' (prefix='kr '); run;
        data t; a = strip(put(1234.5, weight.)); b = strip(put(7041, code.)); c = strip(put(88.4, coin.)); run;""",
        t=("a b c", [("1,234.5 kg", "07-041", "kr 88.40")]),
    )


def test_shipped_formats(check):
    d = day(2016, 8, 17)
    check(
        f"""data t; a = put({d}, date9.); b = put({d}, mmddyy8.); c = put({d}, worddate18.); e = put(3723, time8.); f = put({d} * 86400 + 61, datetime18.); g = strip(put(-1234567.891, comma14.2)); h = put(0.256, percent8.1); i = put(42, 6.1); j = put(., 5.); k = put('herring', $3.); l = strip(put(1e3, dollar9.)); run;""",
        t=("a b c e f g h i j k l", [("17AUG2016", "08/17/16", "August 17, 2016", "01:02:03", "17AUG2016:00:01:01", "-1,234,567.89", "25.6%", "42.0", ".", "her", "$1,000.00")]),
    )


def test_formats_as_tables(check):
    s = check(
        "proc format; value depth low-5='shallow' 6-<20='mid' 20-high='deep'; value $side 'L'='port' 'R'='starboard'; run; proc format cntlout=f; run; proc sort data=f; by fmtname start; run;",
        f=("FMTNAME START END LABEL TYPE HLO SEXCL EEXCL", [("DEPTH", "", "5", "shallow", "N", "L", "N", "N"), ("DEPTH", "20", "", "deep", "N", "H", "N", "N"), ("DEPTH", "6", "20", "mid", "N", "", "N", "Y"), ("SIDE", "L", "L", "port", "C", "", "N", "N"), ("SIDE", "R", "R", "starboard", "C", "", "N", "N")]),
    )
    s.library.formats.clear()
    check("proc format cntlin=f; run; data t; a = put(19.5, depth.); b = put(3, depth.); c = put('R', $side.); run;", t=("a b c", [("mid", "shallow", "starboard")]))


# --- statistics


def test_summaries(check):
    check(
        CATCH + "proc means data=catch noprint; class boat; var kg; output out=o n=trips mean=avg sum=total min=least max=most; run;",
        o=("boat _TYPE_ _FREQ_ trips avg total least most", [("Heron", 1, 2, 2, 100, 200, 80, 120), ("Osprey", 1, 3, 3, 335 / 3, 335, 10, 300), ("Tern", 1, 1, 1, 40, 40, 40, 40)]),
    )


def test_counts(check):
    s = check(
        BOATS + "proc freq data=boats; tables port / out=one; tables port*crew / out=two chisq; run;",
        one=("port COUNT PERCENT", [("Esbjerg", 2, 40), ("Hanstholm", 1, 20), ("Skagen", 2, 40)]),
        two=("port crew COUNT PERCENT", [("Esbjerg", 2, 1, 20), ("Esbjerg", 9, 1, 20), ("Hanstholm", 6, 1, 20), ("Skagen", 2, 1, 20), ("Skagen", 4, 1, 20)]),
    )
    # 5 * (1/(2*2) + 1/(2*1) + 1/(1*1) + 1/(2*2) + 1/(2*1) - 1) = 7.5
    assert any("Chi-Square  DF 6  Value 7.5" in x for x in s.listing)
    check(BOATS + "proc format; value size low-3='few' 4-high='many'; run; proc freq data=boats; format crew size.; tables crew / out=o; run;", o=("crew COUNT PERCENT", [("few", 2, 40), ("many", 3, 60)]))


def test_least_squares(check):
    from stepframe.operators.stats import least_squares

    s = check(lines("r", "x y", "0 1", "1 3", "2 4", "3 8") + lines("g", "kind $ v", "a 4", "a 6", "b 1", "b 2", "b 3", "c 9", "c 11"))
    t, fit = least_squares(s.table("r"), "y", ["x"])
    intercept, slope = t.rows()
    # Sxx = 5, Sxy = 11, Syy = 26, so the slope is 2.2 and the error sum of squares 26 - 24.2 = 1.8
    assert abs(slope[2] - 2.2) < 1e-9 and abs(intercept[2] - 0.7) < 1e-9 and abs(fit["rsquare"] - 24.2 / 26) < 1e-9
    assert abs(slope[3] - (0.9 / 5) ** 0.5) < 1e-9 and abs(slope[4] - 2.2 / (0.9 / 5) ** 0.5) < 1e-9
    t, _ = least_squares(s.table("g"), "v", ["kind"], ["kind"])
    assert [(r[0], r[1], round(r[2], 9)) for r in t.rows()] == [("Intercept", 1, 10), ("kind a", 1, -5), ("kind b", 1, -8), ("kind c", 0, 0)]
    with pytest.raises(ValueError):
        least_squares(s.table("r"), "y", ["x", "x"])


# --- SQL


def test_sql_dialect(check):
    check(
        BOATS + """proc sql; create table a as select boat, crew / 2 as half, 1.0 * crew / 0 as none from boats where port like 's%' order by boat;
        create table b as select port, count(*) as n, total(crew) as t from boats group by port having count(*) > 1 order by port;
        create table c as select boat from boats where boat <> "x like 6/2" and port = "Skagen" order by 1; quit;""",
        a=("boat half none", [("Heron", 2, None), ("Tern", 1, None)]),
        b=("port n t", [("Esbjerg", 2, 11), ("Skagen", 2, 6)]),
        c=("boat", [("Heron",), ("Tern",)]),
    )
    with pytest.raises(ValueError):
        check("proc sql; create table a as select 5 as five; quit;")


def test_sql_joins_and_subqueries(check):
    check(
        BOATS + PORTS + CATCH + """proc sql; create table a as select b.boat, p.depth from boats b left join ports p on b.port = p.port where p.depth is null or p.depth > 10 order by b.boat;
        create table c as select boat, port from boats where boat not in (select boat from catch) order by boat; create table d as select x.boat, x.kg from (select boat, max(kg) as kg from catch group by boat) x, boats b where x.boat = b.boat and b.crew > 3 order by x.kg; quit;""",
        a=("boat depth", [("Gannet", None), ("Heron", 11), ("Tern", 11)]),
        c=("boat port", [("Gannet", "Hanstholm"), ("Puffin", "Esbjerg")]),
        d=("boat kg", [("Heron", 120), ("Osprey", 300)]),
    )


def test_sql_columns_outside_the_groups(check):
    check(lines("t", "g $ a b", "m 1 4", "m 9 4", "k 2 6") + "proc sql; create table o as select g, b, max(a) as a from t group by g order by g; quit;", o=("g b a", [("k", 6, 2), ("m", 4, 9)]))


def test_database(check, tmp_path):
    check(
        f'libname sea sqlite "{tmp_path}/sea.db";\n' + CATCH.replace("data catch;", "data sea.catch;") + BOATS + """proc sql; create table j as select c.boat, c.kg, b.port from sea.catch c join boats b on c.boat = b.boat where c.kg > 100 order by c.kg;
create table p as select * from connection to sea (select boat, count(*) as trips from "catch" group by boat order by boat); execute (delete from "catch" where kg < 20) by sea; quit;
proc append base=sea.catch data=sea.catch(where=(boat='Tern')); run;
data back; set sea.catch; run;
proc sql; drop table sea.catch; quit;""",
        j=("boat kg port", [("Heron", 120, "Skagen"), ("Osprey", 300, "Esbjerg")]),
        p=("boat trips", [("Heron", 2), ("Osprey", 3), ("Tern", 1)]),
        back=("boat kg", [("Heron", 120), ("Heron", 80), ("Tern", 40), ("Osprey", 300), ("Osprey", 25), ("Tern", 40)]),
    )


# --- checks


def test_checks_and_their_report(check):
    s = check(
        lines("t", "trip kg boat $", "1 50 Heron", "2 -4 Skua", "3 . Tern", "3 12 Heron") + BOATS + """proc proof data=t out=bad; require trip; type trip=num boat=char; notnull kg; values boat in ('Heron' 'Tern'); range kg 0 - 40; unique trip; run;
proc proof data=t out=more; key boat references boats(boat); rule "odd trip": mod3 = 1; rule "light": kg < 30 / severity=warn message="heavy catch"; run;""",
        bad=(
            "trip kg boat _rule_ _obs_",
            [(1, 50, "Heron", "range kg 0 - 40", 1), (2, -4, "Skua", "range kg 0 - 40", 2), (2, -4, "Skua", "values boat in (Heron Tern)", 2), (3, None, "Tern", "notnull kg", 3), (3, None, "Tern", "range kg 0 - 40", 3), (3, None, "Tern", "unique trip", 3), (3, 12, "Heron", "unique trip", 4)],
        ),
    )
    assert s.errors > 0 and any("heavy catch" in x or "light" in x for x in s.listing)


# --- writing


def test_text_sinks(check, tmp_path):
    f = tmp_path
    check(
        BOATS + f"""data _null_; set boats; file "{f}/a.csv" dsd; note = catx(',', boat, port); put crew note; run;
data a; infile "{f}/a.csv" dsd; input crew note $; run;
data _null_; set boats; file "{f}/b.txt"; put crew 1-3 boat $ 5-12; run;
data b; infile "{f}/b.txt"; input crew 1-3 boat $ 5-12; run;
data _null_; set boats; file "{f}/c.txt"; put boat @@; run;
data _null_; set boats; file "{f}/d.txt"; put port @; put crew; run;
data _null_; set boats; file "{f}/e.txt"; put crew= boat=; run;
data _null_; set boats; file "{f}/f.txt"; put #1 boat #2 crew; run;""",
        a=("crew note", [(c, f"{b},{p}") for b, c, p in FLEET]),
        b=("crew boat", [(c, b) for b, c, _ in FLEET]),
    )
    assert (f / "c.txt").read_text() == "Heron Osprey Tern Gannet Puffin\n"
    assert (f / "d.txt").read_text().splitlines()[0] == "Skagen 4"
    assert (f / "e.txt").read_text().splitlines()[1] == "crew=9 boat=Osprey"
    assert (f / "f.txt").read_text().splitlines()[:4] == ["Heron", "4", "Osprey", "9"]


def test_import_and_export(check, tmp_path):
    f = tmp_path
    rows = [("Heron, old", 1250000, None), ("Tern", 2.75, 3)]
    check(
        lines("t", "boat $ 1-10 price 12-19 crew 21-22", "Heron, old  1250000  .", "Tern           2.75  3") + f"""proc export data=t outfile="{f}/t.csv" dbms=csv; run; proc import datafile="{f}/t.csv" out=c dbms=csv; getnames=yes; run;
proc export data=t outfile="{f}/t.xlsx" dbms=xlsx; run; proc import datafile="{f}/t.xlsx" out=x dbms=xlsx; run;""",
        c=("boat price crew", rows),
        x=("boat price crew", rows),
    )


# --- macros, listings, errors


def test_macro_text(check):
    check(
        BOATS + """%let least = 5; %macro over(out, of=crew); data &out; set boats; where &of > &least; keep boat; run; %mend; %over(big);
%macro table; data squares; %do n = 2 %to 4; v = &n * &n; output; %end; run; %mend; %table
%macro choose(k); data said; %if &k > 1 %then %do; word = 'many'; %end; %else %do; word = 'single'; %end; run; %mend; %choose(1);""",
        big=("boat", [("Osprey",), ("Gannet",)]),
        squares=("v", [(4,), (9,), (16,)]),
        said=("word", [("single",)]),
    )


def test_listings(session):
    out = session.submit(BOATS + "title 'Fleet'; footnote 'Sea'; proc print data=boats noobs; var port; run; title;")
    assert out[0] == "Fleet" and out[-1] == "Sea" and out[2].strip() == "Skagen"


def test_errors_leave_the_library_alone(session):
    for text in ("data ok; v = 1; run; data broken; v = 1 + ; run;", "data ok; v = 1; run; data broken; set ok; delete; run;"):
        with pytest.raises(ParseError):
            session.submit(text)
    assert "ok" not in session.library.tables


def test_symbolic_equals_interpreter(session):
    from stepframe.lang.parser import parse
    from stepframe.plans.step import run_step

    session.submit(BOATS)
    for body in (
        "more = crew * 3 - 1; if more > 15 then size = 'large'; else if port = 'Skagen' then size = 'north'; else size = 'small'; tag = catx('.', port, more);",
        "array v{2} crew more; more = 1; all = 0; do j = 1 to 2; all = all + v{j} * j; end; if all > 5; drop j;",
        "hands + crew; at = _n_;",
        "if crew > 3 then do; output; crew = -crew; output; end;",
        "d = intnx('month2', crew * 1000, 1, 'm'); n = intck('week.3', 0, crew * 100);",
    ):
        step = parse(f"data o; set boats; {body} run;")[0]
        run_step(step, session.library)
        got = (session.table("o").names, session.table("o").rows())
        run_step(step, session.library, force_interpreter=True)
        assert got == (session.table("o").names, session.table("o").rows()), body


def test_large_whole_numbers_join_texts_plainly(check):
    check("data a; k = 1180001; run; data t; set a; x = cats(k, 'B'); y = catx('-', k * 1000, k + 0.5, -k, .); drop k; run;", t=("x y", [("1180001B", "1180001000-1.1800015e+06--1180001-.")]))
    assert scalar.FUNCTIONS["cats"](1180001.0, "B") == "1180001B" and scalar.FUNCTIONS["catx"]("-", 1e9, -2e6, 1e20) == "1000000000--2000000-1e+20"


def test_percent_ties_are_those_of_the_percentage(check):
    check("data a; p = 99500; output; p = 76500; output; p = 20500; output; run; data t; set a; h = put(p / 1000000, percent8.1); keep h; run;", t=("h", [("9.9%",), ("7.7%",), ("2.0%",)]))


def test_codes_of_more_digits_than_the_picture(session, tmp_path):
    rows = [(7, 1.5, "1-URGENT"), (123456, 2.5, "5-LOW"), (8850017, 3.5, "5-LOW"), (12345678901, 4.5, "5-LOW")]
    session.spark.createDataFrame([(k, p, dt.datetime(2000, 1, 1), w) for k, p, w in rows], "o_orderkey long, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = catalogue.QUERIES["q60_user_formats_and_pictures"](session.spark, str(tmp_path)).orderBy("o_orderkey").collect()
    assert [r.f for r in got] == ["00000-7", "12345-6", "88500-7", "12345-1"]

