import pytest

from tessera.operators import judges

CLEAN = '/**\n * Lists.\n *\n * @param int $id Id.\n * @return string\n */'
UNITS = {
    # name: (body, docblock, function name, what must hold)
    "plain": ("function add( $a ) {\n\treturn $a;\n}", CLEAN, "add", {"i18n": 7, "accessibility": 7, "verdict": "FAIL", "failures": []}),
    "page": ("function show() {\n\techo '<p role=\"note\">' . esc_html__( 'Hello', 'x' ) . '</p>';\n}", CLEAN, "show", {"i18n": 9, "accessibility": 9, "security": 9, "verdict": "PASS", "failures": [], "tags": ["i18n:translation_functions", "a11y:aria_attributes"]}),
    "concatenated": ("function q() {\n\t$wpdb->query( \"DELETE FROM t WHERE id = \" . $id );\n}", CLEAN, "q", {"sql_safety": 1, "failures": ["unprepared_query_with_concat"]}),
    "loose": ("function q() {\n\t$wpdb->query( $sql );\n}", CLEAN, "q", {"sql_safety": 3, "failures": ["possible_unprepared_query"]}),
    "only_table": ("function q() {\n\t$wpdb->query( 'TRUNCATE t' );\n}", CLEAN, "q", {"sql_safety": 9, "failures": []}),
    "prepared": ("function q() {\n\t$wpdb->query( $wpdb->prepare( 'SELECT %d', $id ) );\n}", CLEAN, "q", {"sql_safety": 10, "failures": []}),
    # a deduction before a set score is undone, one after it still counts, and the clamp is last
    "posted_eval": ("function p() {\n\teval( $_POST['c'] ); fopen( 'f' );\n}", CLEAN, "p", {"security": 1, "failures": ["missing_nonce_on_state_change", "eval_usage", "direct_file_operations", "security_auto_fail"]}),
    "this_only": ("function p() {\n\techo $this->name;\n}", CLEAN, "p", {"security": 9, "failures": []}),
    "variable": ("function p() {\n\techo $this->a . $name;\n}", CLEAN, "p", {"security": 7, "failures": ["possible_unescaped_output"]}),
    "undocumented": ("function a() {\n\n\n\n}", "", "a", {"wpcs_compliance": 7, "failures": ["missing_phpdoc"]}),
    "camel": ("function doIt() {}", CLEAN, "doIt", {"wpcs_compliance": 8}),
    "method": ("function doIt() {}", CLEAN, "A::doIt", {"wpcs_compliance": 9}),
    "long": ("function a() {\n" + "\n" * 200 + "}", CLEAN, "a_", {"code_quality": 7, "failures": ["function_too_long"]}),
    "rather_long": ("function a() {\n" + "\n" * 120 + "}", CLEAN, "a_", {"code_quality": 8, "failures": []}),
    "reminders": ("function a() {\n" + "// todo\n" * 4 + "{", CLEAN, "a_", {"code_quality": 7}),
    "recursive": ("function f() { f(); }", CLEAN, "C::f", {"dependency_integrity": 8}),
    "recursive_guarded": ("function f( $depth ) { f( $depth ); }", CLEAN, "f", {"dependency_integrity": 9}),
    "vendor": ("require_once 'x'; require_once( 'vendor/lib.php' );", CLEAN, "v", {"dependency_integrity": 6, "failures": ["direct_vendor_require"]}),
    "autoload": ("require_once( __DIR__ . 'a' ); require_once( 'vendor/autoload.php' );", CLEAN, "v", {"dependency_integrity": 7}),
    "loops": ("foreach ( $a as $b ) { $wpdb->x; get_post_meta( 1 ); }", CLEAN, "l", {"performance": 4, "failures": ["query_in_loop", "wp_query_in_loop"]}),
    "posts_before_loop": ("$a = get_posts( 1 ); foreach ( $a as $b ) { x(); }", CLEAN, "l", {"performance": 9, "failures": []}),
    "posts_after_first_loop": ("get_posts( 1 ); while ( $a ) { y(); }\nforeach ( $a as $b ) {}\nnew  WP_Query();", CLEAN, "l", {"performance": 7, "failures": ["wp_query_in_loop"]}),
    "meta": ("x( 'select * from wp_postmeta' ); // Fixme", CLEAN, "m", {"performance": 7, "failures": ["possible_unprepared_query", "select_star_meta_no_limit"][1:], "code_quality": 9}),
    "hardcoded": ("function h() { echo 'Hello world'; }", CLEAN, "h_", {"i18n": 4, "failures": ["hardcoded_user_facing_strings"]}),
    "image": ("?><img src='x'><input type='hidden'><?php", CLEAN, "i", {"accessibility": 6, "failures": ["image_without_alt_text"]}),
    "field": ("?><input name='x'><?php", CLEAN, "i", {"accessibility": 6, "failures": ["form_input_without_label"]}),
    "route": ("register_rest_route( 'a' );", CLEAN, "r", {"wp_api_usage": 6, "failures": ["rest_route_missing_permission_callback"], "tags": ["rest:route_registration"]}),
    "empty": ("", None, None, {"wpcs_compliance": 9, "i18n": 7, "verdict": "FAIL", "failures": [], "tags": []}),
    "null": (None, None, None, {"wpcs_compliance": 9, "i18n": 7, "verdict": "FAIL", "failures": [], "tags": []}),
}


@pytest.fixture(scope="module")
def verdicts(spark):
    rows = [(k, b, d, n, ["add_action:init"] if k == "plain" else None, ["join", "get_row"] if k == "plain" else []) for k, (b, d, n, _) in UNITS.items()]
    df = spark.createDataFrame(rows, "unit string, code string, doc string, fn string, hooks array<string>, kinds array<string>")
    return {r.unit: r.asDict() for r in judges.judged(df, "unit", "code", "doc", "fn", "hooks", "kinds").collect()}


@pytest.mark.parametrize("unit", UNITS)
def test_units(verdicts, unit):
    want = UNITS[unit][3]
    assert {k: verdicts[unit][k] for k in want} == want


def test_tags_of_hooks_and_queries(verdicts):
    assert verdicts["plain"]["tags"] == ["sql:joins_across_meta", "sql:targeted_select", "hooks:action_registration"]


def test_sum_equals_fold(spark):
    """Every combination of five steps, each with a condition of its own: the flat score equals the steps in their order."""
    from pyspark.sql import functions as F

    steps = [judges.Step("d", "a", -4), judges.Step("d", "b", set_to=3), judges.Step("d", "c", 2), judges.Step("d", "e", set_to=12), judges.Step("d", "f", -3)]
    rows = [tuple(bool(k >> i & 1) for i in range(5)) for k in range(32)]
    df = spark.createDataFrame(rows, "a boolean, b boolean, c boolean, e boolean, f boolean")
    for r in df.select("*", judges._score(9, steps).alias("s")).collect():
        score = 9
        for s in steps:
            if r[s.when]:
                score = s.set_to if s.set_to is not None else score + s.delta
        assert r.s == max(1, min(10, score))


def test_empty_table(spark):
    df = spark.createDataFrame([], "unit string, body string, verdict string")
    assert judges.judged(df, "unit").count() == 0
