"""Server-log sources: physical lines → logical records.

A record starts at a line whose first two tokens are a date and a time with
fractional seconds; every other line continues the current record. Records are
assembled by a segmented scan (``waitwise.sources.segments``): the text is neither
sorted nor windowed, and only the pieces at split borders are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waitwise.sources import segments
from waitwise.sources.bindings import bucket, table

# How a log line that opens a record begins.
START_RE = r"^\s*\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+"
TS_RE = r"^\s*(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})"

# SQLSTATE codes and condition names (the whole public PostgreSQL error-code appendix), in its order.
SQLSTATE_TEXT = """\
00000    successful_completion
01000    warning
0100C    dynamic_result_sets_returned
01008    implicit_zero_bit_padding
01003    null_value_eliminated_in_set_function
01007    privilege_not_granted
01006    privilege_not_revoked
01004    string_data_right_truncation
01P01    deprecated_feature
02000    no_data
02001    no_additional_dynamic_result_sets_returned
03000    sql_statement_not_yet_complete
08000    connection_exception
08003    connection_does_not_exist
08006    connection_failure
08001    sqlclient_unable_to_establish_sqlconnection
08004    sqlserver_rejected_establishment_of_sqlconnection
08007    transaction_resolution_unknown
08P01    protocol_violation
09000    triggered_action_exception
0A000    feature_not_supported
0B000    invalid_transaction_initiation
0F000    locator_exception
0F001    invalid_locator_specification
0L000    invalid_grantor
0LP01    invalid_grant_operation
0P000    invalid_role_specification
0Z000    diagnostics_exception
0Z002    stacked_diagnostics_accessed_without_active_handler
10608    invalid_argument_for_xquery
20000    case_not_found
21000    cardinality_violation
22000    data_exception
2202E    array_subscript_error
22021    character_not_in_repertoire
22008    datetime_field_overflow
22012    division_by_zero
22005    error_in_assignment
2200B    escape_character_conflict
22022    indicator_overflow
22015    interval_field_overflow
2201E    invalid_argument_for_logarithm
22014    invalid_argument_for_ntile_function
22016    invalid_argument_for_nth_value_function
2201F    invalid_argument_for_power_function
2201G    invalid_argument_for_width_bucket_function
22018    invalid_character_value_for_cast
22007    invalid_datetime_format
22019    invalid_escape_character
2200D    invalid_escape_octet
22025    invalid_escape_sequence
22P06    nonstandard_use_of_escape_character
22010    invalid_indicator_parameter_value
22023    invalid_parameter_value
22013    invalid_preceding_or_following_size
2201B    invalid_regular_expression
2201W    invalid_row_count_in_limit_clause
2201X    invalid_row_count_in_result_offset_clause
2202H    invalid_tablesample_argument
2202G    invalid_tablesample_repeat
22009    invalid_time_zone_displacement_value
2200C    invalid_use_of_escape_character
2200G    most_specific_type_mismatch
22004    null_value_not_allowed
22002    null_value_no_indicator_parameter
22003    numeric_value_out_of_range
2200H    sequence_generator_limit_exceeded
22026    string_data_length_mismatch
22001    string_data_right_truncation
22011    substring_error
22027    trim_error
22024    unterminated_c_string
2200F    zero_length_character_string
22P01    floating_point_exception
22P02    invalid_text_representation
22P03    invalid_binary_representation
22P04    bad_copy_file_format
22P05    untranslatable_character
2200L    not_an_xml_document
2200M    invalid_xml_document
2200N    invalid_xml_content
2200S    invalid_xml_comment
2200T    invalid_xml_processing_instruction
22030    duplicate_json_object_key_value
22031    invalid_argument_for_sql_json_datetime_function
22032    invalid_json_text
22033    invalid_sql_json_subscript
22034    more_than_one_sql_json_item
22035    no_sql_json_item
22036    non_numeric_sql_json_item
22037    non_unique_keys_in_a_json_object
22038    singleton_sql_json_item_required
22039    sql_json_array_not_found
2203A    sql_json_member_not_found
2203B    sql_json_number_not_found
2203C    sql_json_object_not_found
2203D    too_many_json_array_elements
2203E    too_many_json_object_members
2203F    sql_json_scalar_required
2203G    sql_json_item_cannot_be_cast_to_target_type
23000    integrity_constraint_violation
23001    restrict_violation
23502    not_null_violation
23503    foreign_key_violation
23505    unique_violation
23514    check_violation
23P01    exclusion_violation
24000    invalid_cursor_state
25000    invalid_transaction_state
25001    active_sql_transaction
25002    branch_transaction_already_active
25008    held_cursor_requires_same_isolation_level
25003    inappropriate_access_mode_for_branch_transaction
25004    inappropriate_isolation_level_for_branch_transaction
25005    no_active_sql_transaction_for_branch_transaction
25006    read_only_sql_transaction
25007    schema_and_data_statement_mixing_not_supported
25P01    no_active_sql_transaction
25P02    in_failed_sql_transaction
25P03    idle_in_transaction_session_timeout
25P04    transaction_timeout
26000    invalid_sql_statement_name
27000    triggered_data_change_violation
28000    invalid_authorization_specification
28P01    invalid_password
2B000    dependent_privilege_descriptors_still_exist
2BP01    dependent_objects_still_exist
2D000    invalid_transaction_termination
2F000    sql_routine_exception
2F005    function_executed_no_return_statement
2F002    modifying_sql_data_not_permitted
2F003    prohibited_sql_statement_attempted
2F004    reading_sql_data_not_permitted
34000    invalid_cursor_name
38000    external_routine_exception
38001    containing_sql_not_permitted
38002    modifying_sql_data_not_permitted
38003    prohibited_sql_statement_attempted
38004    reading_sql_data_not_permitted
39000    external_routine_invocation_exception
39001    invalid_sqlstate_returned
39004    null_value_not_allowed
39P01    trigger_protocol_violated
39P02    srf_protocol_violated
39P03    event_trigger_protocol_violated
3B000    savepoint_exception
3B001    invalid_savepoint_specification
3D000    invalid_catalog_name
3F000    invalid_schema_name
40000    transaction_rollback
40002    transaction_integrity_constraint_violation
40001    serialization_failure
40003    statement_completion_unknown
40P01    deadlock_detected
42000    syntax_error_or_access_rule_violation
42601    syntax_error
42501    insufficient_privilege
42846    cannot_coerce
42803    grouping_error
42P20    windowing_error
42P19    invalid_recursion
42830    invalid_foreign_key
42602    invalid_name
42622    name_too_long
42939    reserved_name
42804    datatype_mismatch
42P18    indeterminate_datatype
42P21    collation_mismatch
42P22    indeterminate_collation
42809    wrong_object_type
428C9    generated_always
42703    undefined_column
42883    undefined_function
42P01    undefined_table
42P02    undefined_parameter
42704    undefined_object
42701    duplicate_column
42P03    duplicate_cursor
42P04    duplicate_database
42723    duplicate_function
42P05    duplicate_prepared_statement
42P06    duplicate_schema
42P07    duplicate_table
42712    duplicate_alias
42710    duplicate_object
42702    ambiguous_column
42725    ambiguous_function
42P08    ambiguous_parameter
42P09    ambiguous_alias
42P10    invalid_column_reference
42611    invalid_column_definition
42P11    invalid_cursor_definition
42P12    invalid_database_definition
42P13    invalid_function_definition
42P14    invalid_prepared_statement_definition
42P15    invalid_schema_definition
42P16    invalid_table_definition
42P17    invalid_object_definition
44000    with_check_option_violation
53000    insufficient_resources
53100    disk_full
53200    out_of_memory
53300    too_many_connections
53400    configuration_limit_exceeded
54000    program_limit_exceeded
54001    statement_too_complex
54011    too_many_columns
54023    too_many_arguments
55000    object_not_in_prerequisite_state
55006    object_in_use
55P02    cant_change_runtime_param
55P03    lock_not_available
55P04    unsafe_new_enum_value_usage
57000    operator_intervention
57014    query_canceled
57P01    admin_shutdown
57P02    crash_shutdown
57P03    cannot_connect_now
57P04    database_dropped
57P05    idle_session_timeout
58000    system_error
58030    io_error
58P01    undefined_file
58P02    duplicate_file
58P03    file_name_too_long
72000    snapshot_too_old
F0000    config_file_error
F0001    lock_file_exists
HV000    fdw_error
HV005    fdw_column_name_not_found
HV002    fdw_dynamic_parameter_value_needed
HV010    fdw_function_sequence_error
HV021    fdw_inconsistent_descriptor_information
HV024    fdw_invalid_attribute_value
HV007    fdw_invalid_column_name
HV008    fdw_invalid_column_number
HV004    fdw_invalid_data_type
HV006    fdw_invalid_data_type_descriptors
HV091    fdw_invalid_descriptor_field_identifier
HV00B    fdw_invalid_handle
HV00C    fdw_invalid_option_index
HV00D    fdw_invalid_option_name
HV090    fdw_invalid_string_length_or_buffer_length
HV00A    fdw_invalid_string_format
HV009    fdw_invalid_use_of_null_pointer
HV014    fdw_too_many_handles
HV001    fdw_out_of_memory
HV00P    fdw_no_schemas
HV00J    fdw_option_name_not_found
HV00K    fdw_reply_handle
HV00Q    fdw_schema_not_found
HV00R    fdw_table_not_found
HV00L    fdw_unable_to_create_execution
HV00M    fdw_unable_to_create_reply
HV00N    fdw_unable_to_establish_connection
P0000    plpgsql_error
P0001    raise_exception
P0002    no_data_found
P0003    too_many_rows
P0004    assert_failure
XX000    internal_error
XX001    data_corrupted
XX002    index_corrupted
"""


def sqlstate_dim(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Lines ``CODE<space>condition_name [comment]`` → (code, condition, ord).

    ``path`` is a text file in that format; by default the built-in list above.
    ``ord`` keeps the dictionary's line order (reports list codes in that order).
    """
    if path is None:
        lines = spark.createDataFrame([(i, t) for i, t in enumerate(SQLSTATE_TEXT.splitlines())],
                                      "ord int, value string")
    else:
        # ids increase in file order (split, then row), which is all ``ord`` needs
        lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), "value")
    pat = r"^([0-9A-Z]{5})\s+([A-Za-z_][A-Za-z_0-9]*)"
    return (lines.filter(F.col("value").rlike(pat))
                 .select(F.regexp_extract("value", pat, 1).alias("code"),
                         F.regexp_extract("value", pat, 2).alias("condition"), "ord"))


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files → (file, chunk, pos, line), ``pos`` ordering lines within a file.

    chunk = the file split's start offset; pos = (split start, row within split).
    Splits are read line-aligned by the text source, so this order is the file order.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("chunk"),
        F.monotonically_increasing_id().alias("_mid"), F.col("value").alias("line"))
    # low 33 bits of the id are the row number inside the partition (= inside the split)
    return raw.select("file", "chunk",
                      F.struct(F.col("chunk").alias("c"), F.expr("_mid & 8589934591").alias("r")).alias("pos"),
                      "line")


def line_ts(line: Column | str) -> Column:
    """The timestamp (to the second) that a line begins with, else NULL."""
    raw = F.nullif(F.regexp_extract(line, TS_RE, 1), F.lit(""))
    return F.to_timestamp_ntz(F.regexp_replace(raw, r"\s+", " "))


def assemble_records(lines: DataFrame, start_filter: str | Column | None = None) -> DataFrame:
    """(file, chunk, pos, line) → (file, rec_pos, ts, record, n_lines).

    The lines of a (file, chunk) stand in file order inside their partition, as a reader of
    splits gives them. Lines before the first record start of a file belong to no record and
    are dropped. ``start_filter`` (a regex, or a condition on ``line``) is tested on a record's
    first line: other records lose their text before the scan, e.g. all but the autovacuum
    records when those are all a report needs.
    """
    keep = F.col("line").rlike(start_filter) if isinstance(start_filter, str) else start_filter
    recs = segments.records(lines, F.col("line").rlike(START_RE), keep)
    return recs.select("file", "rec_pos", line_ts("record").alias("ts"), "record", "n_lines")


def first_split_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of each file's first split: enough for A11, however long the files."""
    return read_log_lines(spark, path).filter(F.col("chunk") == 0)


def read_server_log(spark: SparkSession, path: str) -> DataFrame:
    """A8 from text files."""
    return assemble_records(read_log_lines(spark, path))


def log_prefix_fields(records: DataFrame, col: str = "record") -> DataFrame:
    """Split the first line's ``%m| %d| %a| %u| %h| %p| %e| message`` prefix (message keeps
    continuation lines)."""
    parts = F.split(F.col(col), r"\|", 8)

    def p(i: int) -> Column:
        return F.trim(F.get(parts, i))

    return records.select(
        "file", "rec_pos", "ts", p(1).alias("db"), p(2).alias("app"), p(3).alias("usr"),
        p(4).alias("host"), p(5).alias("pid"), p(6).alias("sqlstate"),
        F.regexp_replace(F.get(parts, 7), r"^\s+", "").alias("message"))


def in_minutes(ts: Column, s: str, f: str) -> Column:
    """Whether the minute of ``ts`` lies in [s, f]."""
    m = bucket(ts, "minute")
    return (m >= F.lit(s).cast("timestamp_ntz")) & (m <= F.lit(f).cast("timestamp_ntz"))


def log_time_slice(records: DataFrame, s: str, f: str) -> DataFrame:
    """A10: records whose minute lies in [s, f] (minute-inclusive on both ends)."""
    return records.filter(in_minutes(F.col("ts"), s, f))


def records_in_slice(lines: DataFrame, s: str, f: str, files: Sequence[str] | None = None) -> DataFrame:
    """A10 from lines: only records of the slice are assembled (a record's first line tells its minute).

    Only ``files`` (names, e.g. from ``log_files_for_date``) are read, if given.
    """
    if files is not None:
        lines = lines.filter(F.col("file").isin(list(files)))
    return assemble_records(lines, in_minutes(line_ts("line"), s, f))


def log_files_for_date(lines: DataFrame, dates: list[str] | None = None,
                       fallback_newest: bool = False) -> DataFrame:
    """Each file's first line and its timestamp; keep files whose first line carries one
    of ``dates`` (all files when None). Accepts many files and many days. With
    ``fallback_newest`` the newest file is returned when no file matches.

    ``lines`` may be the first splits only (``first_split_lines``): a file's first line is there."""
    first = lines.groupBy("file").agg(F.min_by("line", "pos").alias("_first"))
    out = first.select("file", line_ts("_first").alias("first_ts")).filter(F.col("first_ts").isNotNull())
    if dates is not None:
        matched = out.filter(F.to_date("first_ts").cast("string").isin(dates))
        if not fallback_newest:
            return matched
        # no file for the dates: fall back to the newest file (scalar subqueries, no collect)
        n_matched = matched.select(F.count(F.lit(1))).scalar()
        newest = out.select(F.max("first_ts")).scalar()
        return matched.unionByName(out.filter((n_matched == 0) & (F.col("first_ts") == newest)))
    return out


# ---------------------------------------------------------------- fixture: log lines from events
def _num(c: Column) -> Column:
    return c.cast("string")


def _value_text(cents: Column) -> Column:
    return F.concat(_num(F.expr("cents div 100")), F.lit("."), F.lpad(_num(cents % 100), 2, "0"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Server-log lines derived from ``events`` (see FIXTURES): kind = event_id % 6 chooses a
    checkpoint (EN/RU), autovacuum (EN/RU, 3 lines), temporary file or error/warning line.

    Output (file, chunk, pos, line_no, line) with pos = line_no = event_id*4 + k, one
    file per day; a chunk is the split of ``events`` that the lines were read from.
    """
    ev = table(spark, sf_dir, "events").select(
        F.concat_ws(":", F.col("_metadata.file_name"), F.col("_metadata.file_block_start").cast("string")).alias("chunk"),
        "event_id", "ts", "user_id", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    u, e = F.col("user_id"), F.col("event_id")
    # numbers and day that several messages hold are made once, in a step of their own: in one step with the messages
    # the generated method is too long for the JVM to compile, and each line is interpreted
    texts = {"u": u, "u1000": u + 1000, "u3": u * 3, "u5x": u * 5, "mb": u * 1048576,
             **{f"m{k}": u % k for k in (2, 3, 4, 5, 7, 8, 9, 20, 250)}}
    ev = ev.select("*", (e % 6).alias("kind"), (u % 6).alias("sub"), _value_text(F.col("cents")).alias("v"),
                   F.lpad(_num(u % 1000), 3, "0").alias("ms3"), F.date_format("ts", "yyyy-MM-dd").alias("day"),
                   F.date_format("ts", "HH:mm:ss").alias("time"), *[_num(c).alias(f"t_{n}") for n, c in texts.items()])
    kind, sub, v, ms3 = F.col("kind"), F.col("sub"), F.col("v"), F.col("ms3")
    sqlstate = (F.when(kind != 5, F.lit("00000"))
                .when(sub == 0, "40P01").when(sub == 1, "23505").when(sub == 2, "42P01")
                .when(sub == 3, "57P01").when(sub == 4, "01000")
                .when(e % 12 == 5, "53100").otherwise("53400"))
    prefix = F.concat(
        F.col("day"), F.lit(" "), F.col("time"), F.lit("."), F.lpad(_num(e % 1000), 3, "0"), F.lit(" UTC| "),
        F.lit("db"), F.col("t_m5"), F.lit("| psql| role"), F.col("t_m2"), F.lit("| 10.0."), F.col("t_m8"), F.lit("."),
        F.col("t_m250"), F.lit("| "), F.col("t_u1000"), F.lit("| "), sqlstate, F.lit("| "))
    name = F.when(u % 4 == 0, F.concat(F.lit("public.t"), F.col("t_m20"))).otherwise(
        F.concat(F.lit("db"), F.col("t_m5"), F.lit(".public.t"), F.col("t_m20")))
    ck_en = F.concat(
        F.lit("LOG:  checkpoint complete: wrote "), F.col("t_u3"), F.lit(" buffers (0.1%); "), F.col("t_m2"),
        F.lit(" WAL file(s) added, "), F.col("t_m4"), F.lit(" removed, "), F.col("t_m5"), F.lit(" recycled; write="), v,
        F.lit(" s, sync=0."), ms3, F.lit(" s, total="), v, F.lit(" s; sync files="), F.col("t_m9"),
        F.lit(", longest=0.001 s, average=0.001 s; distance="), F.col("t_u"), F.lit(" kB, estimate="), F.col("t_u"),
        F.lit(" kB"))
    ck_ru = F.concat(
        F.lit("СООБЩЕНИЕ:  контрольная точка завершена: записано буферов: "), F.col("t_u3"),
        F.lit(" (0.1%); добавлено файлов WAL "), F.col("t_m2"), F.lit(", удалено: "), F.col("t_m4"),
        F.lit(", переработано: "), F.col("t_m5"), F.lit("; запись="), v, F.lit(" сек., синхр.=0."), ms3,
        F.lit(" сек., всего="), v, F.lit(" сек.; синхронизировано_файлов="), F.col("t_m9"),
        F.lit(", самая_долгая_синхр.=0.001 сек., средняя=0.001 сек.; расстояние="), F.col("t_u"),
        F.lit(" kB, ожидалось="), F.col("t_u"), F.lit(" kB"))
    av_en = F.array(
        F.concat(prefix, F.lit('LOG:  automatic vacuum of table "'), name, F.lit('": index scans: '), F.col("t_m3")),
        F.concat(F.lit("\tpages: "), F.col("t_m7"), F.lit(" removed, "), F.col("t_u5x"),
                 F.lit(" remain, 0 skipped due to pins, 0 skipped frozen")),
        F.concat(F.lit("\tsystem usage: CPU: user: 0.01 s, system: 0.00 s, elapsed: "), v, F.lit(" s")))
    av_ru = F.array(
        F.concat(prefix, F.lit('СООБЩЕНИЕ:  автоматическая очистка таблицы "'), name,
                 F.lit('": сканирований индекса: '), F.col("t_m3")),
        F.concat(F.lit("\tстраниц удалено: "), F.col("t_m7"), F.lit(", осталось: "), F.col("t_u5x"),
                 F.lit(", пропущено закреплённых: 0, пропущено замороженных: 0")),
        F.concat(F.lit("\tиспользование системы: ЦП: пользов.: 0.01 с, система: 0.00 с, прошло: "), v, F.lit(" с")))
    size = F.col("t_mb")
    tmp = F.when(u % 2 == 0, F.concat(F.lit('LOG:  temporary file: path "base/pgsql_tmp/pgsql_tmp'), F.col("t_u1000"),
                                      F.lit('.0", size '), size)).otherwise(
        F.concat(F.lit('СООБЩЕНИЕ:  временный файл: путь "base/pgsql_tmp/pgsql_tmp'), F.col("t_u1000"),
                 F.lit('.0", размер '), size))
    err = (F.when(sub == 0, F.lit("ERROR:  deadlock detected"))
           .when(sub == 1, F.concat(F.lit('ERROR:  duplicate key value violates unique constraint "t'), F.col("t_u"),
                                    F.lit('_pkey"')))
           .when(sub == 2, F.concat(F.lit('ОШИБКА:  отношение "t'), F.col("t_u"), F.lit('" не существует')))
           .when(sub == 3, F.lit("FATAL:  terminating connection due to administrator command"))
           .when(sub == 4, F.concat(F.lit("WARNING:  checkpoints are occurring too frequently ("), _num(u % 30 + 1),
                                    F.lit(" seconds apart)")))
           .when(e % 12 == 5, F.lit("WARNING:  could not write to log file: No space left on device"))
           .otherwise(F.lit("WARNING:  temporary file size exceeds temp_file_limit (1024kB)")))
    one = (F.when(kind == 0, ck_en).when(kind == 1, ck_ru).when(kind == 4, tmp).otherwise(err))
    lines = (F.when(kind == 2, av_en).when(kind == 3, av_ru).otherwise(F.array(F.concat(prefix, one))))
    out = ev.select("chunk", "day", "event_id", F.posexplode(lines).alias("k", "line"))
    line_no = F.col("event_id") * 4 + F.col("k")
    return out.select(
        F.concat(F.lit("postgresql-"), F.col("day"), F.lit(".log")).alias("file"),
        "chunk", line_no.alias("pos"), line_no.alias("line_no"), "line")
