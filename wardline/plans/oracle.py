"""Independent SQL twins of the registered queries (the correctness oracle).

Each text is the adapter CTE block (FIXTURES.md §4, same derivation as
``wardline.sources.hospital``) followed by the operator written directly in
SQL, for DuckDB over the driver's pre-registered input views.  Results cast
integers to BIGINT and days to text, matching ``catalog.portable``.
"""

from __future__ import annotations

ADAPTER = """
WITH ev AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(ts AS DATE) AS d, 4 * (event_id // 4) + 1 AS bk,
         CASE WHEN value >= 20 THEN CAST(user_id+1 AS BIGINT) END AS account,
         CAST(hour(ts)*3600 + minute(ts)*60 + second(ts) AS INT) AS sod,
         CAST(FLOOR(event_id/8) AS BIGINT) AS m FROM events),
departments AS (
  SELECT CAST(r_regionkey+1 AS INT) AS id, r_name AS name,
         concat('Care unit ', CAST(r_regionkey+1 AS VARCHAR)) AS description FROM region),
doctors AS (
  SELECT CAST(s_suppkey+1 AS INT) AS id, s_name AS name, CAST(n_regionkey+1 AS INT) AS department_id,
         CAST(300 + 50*(s_suppkey%8) AS INT) AS fees,
         CASE WHEN s_suppkey%5=4 THEN NULL ELSE concat('Block ', CAST(s_suppkey%5 AS VARCHAR)) END AS floor_block,
         CASE s_suppkey%3 WHEN 0 THEN 'East' WHEN 1 THEN 'West' ELSE NULL END AS wing,
         CASE WHEN s_suppkey%7=3 THEN '' ELSE concat('R', CAST(100 + s_suppkey%40 AS VARCHAR)) END AS room_number,
         (s_suppkey%6 <> 5) AS available
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
tokens0 AS (
  SELECT CAST(event_id+1 AS BIGINT) AS id, event_id, CAST((event_id+user_id)%(SELECT count(*) FROM supplier)+1 AS INT) AS doctor_id,
         CASE WHEN event_id%3=0 THEN NULL ELSE CAST(user_id+1 AS BIGINT) END AS patient_id,
         concat('Patient ', CAST(user_id+1 AS VARCHAR)) AS patient_name,
         concat('9', printf('%09d', user_id+1)) AS patient_phone,
         ts AS created_at, d AS queue_date, sod AS created_sod,
         CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'cancelled'
                         WHEN 'signup' THEN 'consulting' ELSE 'waiting' END AS status,
         CASE WHEN event_id%12=0 THEN 'prebooked' WHEN event_id%14=2 THEN 'review'
              WHEN event_id%22=6 THEN NULL ELSE 'walkin' END AS token_type,
         CASE WHEN event_id%26=4 THEN 'prebooked' ELSE 'walkin' END AS type,
         CASE WHEN event_id%10=0 THEN NULL ELSE CAST((sod + 600*(event_id%5))%86400 AS INT) END AS expected_sod
  FROM ev WHERE event_id%2 = 0),
tokens AS (
  SELECT t.*, dr.department_id,
         CASE WHEN token_type='prebooked' THEN concat('PB', printf('%03d', event_id+1)) ELSE NULL END AS booking_id,
         CASE WHEN token_type='prebooked' THEN concat('PB', printf('%03d', event_id+1))
              ELSE concat(upper(substr(dp.name,1,1)), printf('%03d', row_number() OVER (
                   PARTITION BY dr.department_id, queue_date ORDER BY created_at, t.id))) END AS token_number
  FROM tokens0 t JOIN doctors dr ON t.doctor_id = dr.id JOIN departments dp ON dr.department_id = dp.id),
prebooked_appointments AS (
  SELECT b.*, dr.department_id FROM (
    SELECT CAST(event_id+1 AS BIGINT) AS id, concat('PB', printf('%03d', event_id)) AS booking_id,
           CAST((event_id-1+user_id)%(SELECT count(*) FROM supplier)+1 AS INT) AS doctor_id,
           concat('Patient ', CAST(user_id+1 AS VARCHAR)) AS patient_name,
           concat('9', printf('%09d', user_id+1)) AS patient_phone,
           d AS appointment_date, CAST(sod - sod%900 AS INT) AS appointment_sod,
           CASE event_type WHEN 'purchase' THEN 'checked_in' WHEN 'error' THEN 'cancelled'
                           WHEN 'signup' THEN 'confirmed' ELSE 'booked' END AS status,
           ts AS created_at
    FROM ev WHERE event_id%4 = 1) b LEFT JOIN doctors dr ON b.doctor_id = dr.id),
lab_tests AS (
  SELECT * FROM (VALUES (1,'MRI','MRI Scan',45,8000,45,12,21), (2,'CT','CT Scan',25,5000,30,16,14),
                        (3,'BT','Blood Test',10,500,10,50,7), (4,'XR','X-Ray',15,800,15,30,7))
  AS t(test_id, test_code, test_name, duration_minutes, fee, slot_duration, daily_capacity, advance_booking_days)),
lab_tokens AS (
  SELECT CAST(event_id+1 AS BIGINT) AS token_id, event_id, l.test_id,
         concat('Patient ', CAST(user_id+1 AS VARCHAR)) AS patient_name,
         CAST(user_id+1 AS BIGINT) AS patient_id,
         concat('9', printf('%09d', user_id+1)) AS patient_phone,
         CASE WHEN m%3=0 THEN 'prebooked' ELSE 'walkin' END AS patient_type,
         CASE WHEN m%3=0 THEN CAST(event_id+5 AS BIGINT) ELSE NULL END AS booking_id,
         d AS scheduled_date, CASE WHEN m%5=0 THEN NULL ELSE sod END AS scheduled_sod, ts AS created_at,
         CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'cancelled'
                         WHEN 'signup' THEN 'in_progress' ELSE 'waiting' END AS token_status,
         concat(l.test_code, '-', printf('%03d', row_number() OVER (
                PARTITION BY l.test_id, d ORDER BY ts, event_id))) AS token_number,
         CAST(row_number() OVER (PARTITION BY l.test_id, d ORDER BY ts, event_id) AS INT) AS queue_position
  FROM ev JOIN lab_tests l ON l.test_id = m%4+1 WHERE event_id%8 = 3),
prebooked_lab_appointments AS (
  SELECT CAST(event_id+1 AS BIGINT) AS booking_id, concat('LB', printf('%03d', event_id)) AS booking_code,
         CAST(m%4+1 AS INT) AS test_id, concat('Patient ', CAST(user_id+1 AS VARCHAR)) AS patient_name,
         concat('9', printf('%09d', user_id+1)) AS patient_phone,
         d AS appointment_date, CAST(sod - sod%900 AS INT) AS appointment_sod, ts AS created_at,
         CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'cancelled'
                         WHEN 'signup' THEN 'checked_in' ELSE 'booked' END AS booking_status
  FROM ev WHERE event_id%8 = 7),
pharmacies AS (
  SELECT CAST(n_nationkey+1 AS INT) AS id, concat(n_name, ' Pharmacy') AS name,
         substr('ABCDE', CAST(n_nationkey%5+1 AS INT), 1) AS block, CAST(n_nationkey%4 AS VARCHAR) AS floor,
         CASE n_regionkey WHEN 0 THEN 'East' WHEN 1 THEN 'West' WHEN 2 THEN 'North' WHEN 3 THEN 'South'
                          ELSE 'Central' END AS wing,
         (n_nationkey%6 <> 5) AS is_active,
         CASE WHEN n_nationkey%3=0 THEN NULL ELSE concat('Cash ', CAST(n_nationkey%3 AS VARCHAR)) END AS cash_counter,
         CASE WHEN n_nationkey%4=1 THEN NULL ELSE concat('Online ', CAST(n_nationkey%4 AS VARCHAR)) END AS online_counter
  FROM nation),
pharmacy_tokens AS (
  SELECT CAST(event_id+1 AS BIGINT) AS id, event_id, CAST(user_id%25+1 AS INT) AS pharmacy_id,
         concat('Patient ', CAST(user_id+1 AS VARCHAR)) AS patient_name,
         concat('9', printf('%09d', user_id+1)) AS patient_phone,
         ts AS created_at, d AS queue_date, sod AS created_sod,
         CASE WHEN event_id%2=0 THEN 'cash' ELSE 'online' END AS payment_method,
         CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'cancelled'
                         WHEN 'signup' THEN 'processing' ELSE 'waiting' END AS status,
         concat('PH', CAST(user_id%25+1 AS VARCHAR), '-', printf('%03d', row_number() OVER (
                PARTITION BY user_id%25, d ORDER BY ts, event_id))) AS token_number
  FROM ev WHERE event_id%3 = 0),
status_log AS (
  SELECT event_id AS req_id, ts, d, CAST(2 * (event_id // 2) + 1 - 2*(m%5) AS BIGINT) AS token_id,
         CASE event_type WHEN 'view' THEN 'waiting' WHEN 'purchase' THEN 'completed'
                         WHEN 'error' THEN 'cancelled' ELSE 'consulting' END AS new_status
  FROM ev WHERE 2 * (event_id // 2) + 1 - 2*(m%5) >= 1),
break_log AS (
  SELECT event_id AS req_id, ts, d, CAST(user_id%(SELECT count(*) FROM supplier)+1 AS INT) AS doctor_id,
         CASE event_type WHEN 'signup' THEN 'start_break' ELSE 'end_break' END AS action
  FROM ev WHERE event_type IN ('signup','purchase')),
lookup_log AS (
  SELECT event_id AS req_id, ts, d,
         CASE WHEN event_id%3=0 THEN CAST(user_id+1 AS BIGINT) ELSE NULL END AS patient_id,
         concat('9', printf('%09d', user_id+1)) AS patient_phone,
         concat(CASE WHEN m%4=0 THEN 'pb' ELSE 'PB' END, printf('%03d', bk - 4*(m%3))) AS booking_id,
         concat(CASE WHEN m%5=0 THEN ' lb' ELSE 'LB' END, printf('%03d', 8*m + 7)) AS lab_code,
         CASE m%3 WHEN 0 THEN concat('PB', printf('%03d', bk))
                  WHEN 1 THEN concat('a', printf('%03d', m%30 + 1)) ELSE '' END AS token
  FROM ev),
cancel_log AS (
  SELECT event_id AS req_id, ts, d,
         CASE WHEN m%3=0 THEN CAST(2 * (event_id // 2) - 3 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS token_id,
         CASE m%3 WHEN 0 THEN '' WHEN 1 THEN concat(' pb', printf('%03d', bk - 4))
                  ELSE concat('A', printf('%03d', m%40 + 1)) END AS token,
         CASE WHEN m%4=2 THEN concat('PB', printf('%03d', bk - 8)) ELSE NULL END AS booking_id,
         CASE WHEN event_type='error' THEN 'at patient request' ELSE NULL END AS reason,
         (event_type <> 'view') AS notify
  FROM ev),
booking_cancel_log AS (
  SELECT event_id AS req_id, ts, d,
         concat(CASE WHEN m%3=0 THEN 'pb' ELSE 'PB' END, printf('%03d', bk - 8)) AS booking_id
  FROM ev),
reschedule_log AS (
  SELECT event_id AS req_id, ts, d, concat('PB', printf('%03d', bk)) AS booking_id,
         CASE event_type WHEN 'error' THEN replace(CAST(d AS VARCHAR), '-', '/')
                         WHEN 'click' THEN CAST(d - 1 AS VARCHAR)
                         WHEN 'signup' THEN ''
                         WHEN 'view' THEN CAST(d AS VARCHAR)
                         ELSE CAST(d + 2 AS VARCHAR) END AS new_date,
         CASE m%3 WHEN 0 THEN ''
                  WHEN 1 THEN printf('%02d:%02d:00', (sod // 3600 + 1) % 24, (sod // 60) % 60 - (sod // 60) % 15)
                  ELSE '9:30' END AS new_time
  FROM ev),
lab_cancel_log AS (
  SELECT event_id AS req_id, ts, d,
         concat(CASE WHEN m%2=0 THEN 'lb' ELSE 'LB' END, printf('%03d', 8*m - 1)) AS booking_code
  FROM ev),
pharmacy_cancel_log AS (
  SELECT event_id AS req_id, ts, d,
         CASE WHEN m%4=3 THEN CAST(0 AS BIGINT) ELSE CAST(3 * (event_id // 3) + 1 - 3*(m%3) AS BIGINT) END AS token_id,
         CASE WHEN m%4=3 THEN concat('PH', CAST(user_id%25+1 AS VARCHAR), '-', printf('%03d', m%50 + 1))
              ELSE '' END AS token_number,
         CASE WHEN event_type <> 'error' THEN 'Patient left' ELSE NULL END AS reason
  FROM ev),
pharmacy_status_log AS (
  SELECT event_id AS req_id, ts, d, CAST(3 * (event_id // 3) + 1 - 3*(m%4) AS BIGINT) AS token_id,
         CASE event_type WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed'
                         WHEN 'error' THEN 'cancelled' WHEN 'click' THEN 'waiting' ELSE 'ready' END AS new_status
  FROM ev),
lab_status_log AS (
  SELECT event_id AS req_id, ts, d, CAST(8*m + 4 - 8*(m%3) AS BIGINT) AS token_id,
         CASE event_type WHEN 'view' THEN 'in_progress' WHEN 'purchase' THEN 'completed'
                         WHEN 'error' THEN 'cancelled' WHEN 'click' THEN 'waiting' ELSE 'no_show' END AS new_status
  FROM ev),
checkin_log AS (
  SELECT event_id AS req_id, ts, d, account AS patient_id,
         concat(CASE WHEN m%5=1 THEN 'pb' ELSE 'PB' END, printf('%03d', bk - 4*(m%2))) AS booking_id
  FROM ev WHERE event_type = 'error'),
opd_issue_log AS (
  SELECT e.event_id AS req_id, e.ts, e.d,
         CAST(CASE WHEN e.event_id%11=5 THEN 0 ELSE (e.event_id+e.user_id)%(SELECT count(*) FROM supplier)+1 END AS INT) AS doctor_id,
         CASE e.event_id%7 WHEN 0 THEN '' WHEN 1 THEN lower(dp.name) WHEN 2 THEN 'Cardiology' ELSE dp.name END
           AS department,
         concat('Patient ', CAST(e.user_id+1 AS VARCHAR)) AS patient_name,
         e.account AS patient_id,
         CASE WHEN e.event_id%31=0 THEN '' WHEN e.event_type='click'
              THEN concat('9', printf('%09d', e.user_id - e.user_id%2 + 1)) ELSE concat('9', printf('%09d', e.user_id+1))
              END AS patient_phone
  FROM ev e LEFT JOIN doctors dr ON dr.id = CAST((e.event_id+e.user_id)%(SELECT count(*) FROM supplier)+1 AS INT)
            LEFT JOIN departments dp ON dp.id = dr.department_id
  WHERE e.event_type IN ('click', 'view')),
lab_issue_log AS (
  SELECT event_id AS req_id, ts, d,
         CASE m%7 WHEN 0 THEN 'ecg' WHEN 1 THEN lower(l.test_code) WHEN 2 THEN concat(' ', l.test_code, ' ')
                  ELSE l.test_code END AS test_code,
         CASE WHEN event_id%13=0 THEN '' ELSE concat('Patient ', CAST(user_id+1 AS VARCHAR)) END AS patient_name,
         CAST(CASE WHEN event_id%17=0 THEN 0 ELSE 18 + user_id%60 END AS INT) AS patient_age,
         CASE user_id%4 WHEN 0 THEN 'Male' WHEN 1 THEN 'female' WHEN 2 THEN 'x' ELSE '' END AS patient_gender,
         account AS patient_id, concat('9', printf('%09d', user_id+1)) AS patient_phone,
         CAST(CASE WHEN m%2=0 THEN 0 ELSE 100*(m%7) END AS INT) AS payment_amount
  FROM ev JOIN lab_tests l ON l.test_id = m%4+1 WHERE event_type IN ('purchase', 'signup')),
issued_log AS (
  SELECT event_id AS req_id, ts, d, 1000000000000 + event_id - 1 - m%6 AS token_id,
         CASE event_type WHEN 'view' THEN 'waiting' WHEN 'signup' THEN 'consulting' WHEN 'error' THEN 'cancelled'
                         ELSE 'completed' END AS new_status,
         CASE event_type WHEN 'view' THEN 'waiting' WHEN 'signup' THEN 'in_progress' WHEN 'error' THEN 'cancelled'
                         ELSE 'completed' END AS lab_status
  FROM ev),
pharmacy_issue_log AS (
  SELECT event_id AS req_id, ts, d,
         CAST(CASE WHEN event_id%19=0 THEN 6 WHEN event_id%23=0 THEN 0 ELSE user_id%25+1 END AS INT) AS pharmacy_id,
         CASE WHEN event_id%29=0 THEN '' ELSE concat('Patient ', CAST(user_id+1 AS VARCHAR)) END AS patient_name,
         concat('9', printf('%09d', user_id+1)) AS patient_phone,
         CASE WHEN event_id%2=0 THEN 'cash' ELSE 'online' END AS payment_method
  FROM ev),
staff AS (
  SELECT CAST(c_custkey+1 AS INT) AS id, c_name AS name,
         concat(lower(replace(c_name, '#', '.')), '@clinic.test') AS email,
         CASE c_custkey%3 WHEN 0 THEN 'doctor' WHEN 1 THEN 'nurse' ELSE 'reception' END AS role,
         CAST(CASE WHEN c_custkey%7=0 THEN NULL ELSE c_nationkey%6 + 1 END AS INT) AS dept_id,
         CAST(CASE WHEN c_custkey%3=0 THEN c_custkey%100 + 1 END AS INT) AS doc_id
  FROM customer WHERE c_acctbal >= 2500 OR c_acctbal IS NULL),
pharmacy_staff AS (
  SELECT CAST(c_custkey+1 AS INT) AS id, concat('PHS', printf('%04d', c_custkey)) AS staff_id, c_name AS name,
         CAST(c_nationkey%27 + 1 AS INT) AS pharmacy_id
  FROM customer WHERE c_acctbal < 2500)
"""

# One scan of the open tokens says what each is; bookings without a token are a set difference of (day, key).
_OPEN = """,
open_tokens AS (
  SELECT *, starts_with(upper(token_number), 'PB') AS numbered_pb,
         list_filter([token_type, type, 'walkin'], lambda x: x IS NOT NULL)[1] AS kind,
         CAST(status = 'waiting' AS INT) AS behind
  FROM tokens WHERE list_contains(['waiting', 'consulting'], status)),
held_keys AS (SELECT queue_date AS day, unnest([token_number, booking_id]) AS k, unnest(['number', 'booking']) AS of
              FROM tokens WHERE status <> 'cancelled'),
absent AS (
  SELECT appointment_date AS day, upper(trim(booking_id)) AS k FROM prebooked_appointments WHERE status = 'booked'
  EXCEPT SELECT day, upper(trim(k)) FROM held_keys WHERE of = 'number'),
missing AS (SELECT pb.*, a.day FROM absent a JOIN prebooked_appointments pb
            ON pb.appointment_date = a.day AND upper(trim(pb.booking_id)) = a.k AND pb.status = 'booked')
"""

# A token stands in the queue once for each thing that it is: pre-booked (branch 1), walk-in (branch 2).
_LIVE_ROWS = _OPEN + """,
placed AS (
  SELECT *, unnest(list_filter([
    {'branch': CASE WHEN numbered_pb OR list_contains([token_type, type], 'prebooked') THEN 1 END,
     'at': ifnull(expected_sod, created_sod)},
    {'branch': CASE WHEN NOT numbered_pb AND kind <> 'prebooked' THEN 2 END, 'at': created_sod}],
    lambda x: x.branch IS NOT NULL)) AS place FROM open_tokens),
lq_rows AS (
  SELECT id, token_number, patient_name, kind AS token_type, status, doctor_id, queue_date, place.at AS appointment_sod,
         created_at, 'checked_in' AS checkin_status, place.branch AS branch, behind,
         CAST(NOT numbered_pb AND kind <> 'prebooked' AS INT) AS walk FROM placed
  UNION ALL
  SELECT id, booking_id, patient_name, 'prebooked', 'waiting', doctor_id, day, appointment_sod, NULL, 'not_checked_in',
         3, 1, 0 FROM missing)
"""

_LIVE_ORDER = "ORDER BY behind, walk, appointment_sod NULLS FIRST, created_at NULLS FIRST, branch, id"


def _live(partition: str) -> str:
    return ADAPTER + _LIVE_ROWS + f"""
SELECT CAST(queue_date AS VARCHAR) AS queue_date,
       CAST(row_number() OVER w AS BIGINT) AS position, CAST(id AS BIGINT) AS id, token_number,
       patient_name, token_type, status, CAST(doctor_id AS BIGINT) AS doctor_id, checkin_status,
       CAST(appointment_sod AS BIGINT) AS appointment_sod,
       CAST(row_number() OVER w - 1 AS BIGINT) AS people_ahead,
       CAST(count(*) OVER (PARTITION BY {partition}) AS BIGINT) AS total_in_queue
FROM lq_rows
WINDOW w AS (PARTITION BY {partition} {_LIVE_ORDER})
"""


def _hms(x: str) -> str:
    return f"printf('%02d:%02d:%02d', {x} // 3600, ({x} // 60) % 60, {x} % 60)"


SQL: dict[str, str] = {}

SQL["live_queue"] = _live("queue_date, doctor_id")
SQL["live_queue_day"] = _live("queue_date")

SQL["combined_queue_script"] = ADAPTER + _OPEN + f""",
shown AS (
  SELECT *, unnest(list_filter([
    {{'branch': CASE WHEN numbered_pb OR token_type = 'prebooked' THEN 1 END, 'kind': 'prebooked',
      'at': ifnull(expected_sod, created_sod)}},
    {{'branch': CASE WHEN NOT numbered_pb THEN 2 END, 'kind': ifnull(token_type, 'walkin'), 'at': created_sod}}],
    lambda x: x.branch IS NOT NULL)) AS s FROM open_tokens),
line AS (
  SELECT queue_date, id, token_number, patient_name, s.kind AS token_type, status, s.at AS minute, 'checked_in' AS checkin_status,
         s.branch AS branch, behind, CAST(NOT numbered_pb AND s.kind <> 'prebooked' AS INT) AS walk FROM shown
  UNION ALL
  SELECT day, id, booking_id, patient_name, 'prebooked', 'waiting', appointment_sod, 'not_checked_in', 3, 1, 0 FROM missing)
SELECT CAST(queue_date AS VARCHAR) AS queue_date,
       CAST(row_number() OVER (PARTITION BY queue_date ORDER BY behind, walk, minute NULLS FIRST, branch, id) AS BIGINT)
         AS position,
       token_number, patient_name, token_type, status, {_hms('minute')} AS appointment_time, checkin_status
FROM line
"""

SQL["simple_queue"] = ADAPTER + f"""
SELECT CAST(queue_date AS VARCHAR) AS queue_date,
       CAST(row_number() OVER (PARTITION BY queue_date ORDER BY
            CASE WHEN status = 'consulting' THEN 0 WHEN token_type = 'prebooked' THEN 1
                 WHEN token_type = 'review' THEN 2 ELSE 3 END, created_at, id) AS BIGINT) AS position,
       token_number, patient_name, COALESCE(token_type, 'walkin') AS token_type, status,
       {_hms('created_sod')} AS created_time
FROM tokens WHERE status IN ('waiting', 'consulting')
"""

SQL["queue_neighbourhood"] = ADAPTER + _LIVE_ROWS + f""",
q AS (
  SELECT queue_date, token_number, status, checkin_status, token_type,
         row_number() OVER (PARTITION BY queue_date {_LIVE_ORDER}) AS position,
         count(*) OVER (PARTITION BY queue_date) AS n
  FROM lq_rows),
me AS (
  SELECT queue_date, upper(token_number) AS viewer_token, max(position) AS viewer_position, max(n) AS n
  FROM q GROUP BY queue_date, upper(token_number)),
st AS (
  SELECT *, CASE WHEN greatest(0, viewer_position - 3) + 5 > n THEN greatest(0, n - 5)
                 ELSE greatest(0, viewer_position - 3) END AS start FROM me)
SELECT CAST(st.queue_date AS VARCHAR) AS queue_date, st.viewer_token,
       CAST(st.viewer_position AS BIGINT) AS viewer_position,
       CAST(q.position AS BIGINT) AS shown_position, q.token_number AS shown_token, q.status,
       q.checkin_status, q.token_type, upper(q.token_number) = st.viewer_token AS is_you
FROM st JOIN q ON q.queue_date = st.queue_date AND q.position > st.start AND q.position <= st.start + 5
"""

SQL["lab_queue"] = ADAPTER + """,
no_token AS (
  SELECT booking_id, appointment_date AS day FROM prebooked_lab_appointments WHERE booking_status = 'booked'
  EXCEPT SELECT booking_id, scheduled_date FROM lab_tokens WHERE token_status <> 'cancelled'),
line AS (
  SELECT token_id AS id, token_number, patient_name, patient_type, token_status AS status, test_id, scheduled_date AS day,
         scheduled_sod AS due, created_at, ['checked_in', 'not_checked_in'][1] AS checkin_status
  FROM lab_tokens WHERE list_contains(['waiting', 'in_progress'], token_status)
  UNION ALL
  SELECT b.booking_id, b.booking_code, b.patient_name, 'prebooked', b.booking_status, b.test_id, n.day, b.appointment_sod,
         b.created_at, 'not_checked_in'
  FROM no_token n JOIN prebooked_lab_appointments b ON b.booking_id = n.booking_id AND b.appointment_date = n.day),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY day, test_id ORDER BY CAST(status <> 'in_progress' AS INT), due NULLS FIRST,
                               created_at NULLS FIRST, checkin_status, id) AS n,
         count(*) OVER (PARTITION BY day, test_id) AS total FROM line)
SELECT CAST(day AS VARCHAR) AS queue_date, CAST(r.test_id AS BIGINT) AS test_id, t.test_name, CAST(n AS BIGINT) AS position,
       CAST(id AS BIGINT) AS id, token_number, patient_name, patient_type, r.status, checkin_status,
       CAST(n - 1 AS BIGINT) AS people_ahead, CAST(total AS BIGINT) AS total_in_queue
FROM ranked r LEFT JOIN lab_tests t ON t.test_id = r.test_id
"""

SQL["doctor_worklist"] = ADAPTER + _OPEN + """,
tiers AS (
  SELECT *, list_position([status = 'consulting', kind = 'prebooked' OR numbered_pb, kind = 'review', TRUE], TRUE) - 1 AS tier
  FROM open_tokens),
ranked AS (SELECT *, row_number() OVER (PARTITION BY queue_date, doctor_id ORDER BY tier, expected_sod NULLS FIRST, id) AS n
           FROM tiers)
SELECT CAST(queue_date AS VARCHAR) AS queue_date, CAST(doctor_id AS BIGINT) AS doctor_id, CAST(n AS BIGINT) AS position,
       CAST(id AS BIGINT) AS id, token_number, patient_name, kind AS type, status,
       CAST(expected_sod AS BIGINT) AS expected_sod, CAST(department_id AS BIGINT) AS department_id,
       CAST(tier AS BIGINT) AS priority_order, 'checked_in' AS checkin_status
FROM ranked WHERE n <= 20
"""

SQL["expected_arrivals"] = ADAPTER + _OPEN + """,
due AS (
  SELECT appointment_date AS day, upper(trim(booking_id)) AS k FROM prebooked_appointments
  WHERE list_contains(['booked', 'confirmed'], status)
  EXCEPT SELECT day, upper(trim(k)) FROM held_keys),
ranked AS (
  SELECT p.*, row_number() OVER (PARTITION BY d.day, doctor_id ORDER BY appointment_sod, id) AS n
  FROM due d JOIN prebooked_appointments p ON p.appointment_date = d.day AND upper(trim(p.booking_id)) = d.k
  WHERE list_contains(['booked', 'confirmed'], p.status))
SELECT CAST(appointment_date AS VARCHAR) AS queue_date, CAST(doctor_id AS BIGINT) AS doctor_id, CAST(n AS BIGINT) AS position,
       CAST(id AS BIGINT) AS prebook_id, booking_id AS token_number, patient_name, 'prebooked' AS type,
       'not_arrived' AS status, CAST(appointment_sod AS BIGINT) AS expected_sod, 'not_checked_in' AS checkin_status
FROM ranked WHERE n <= 10
"""

SQL["all_tokens"] = ADAPTER + f"""
SELECT CAST(queue_date AS VARCHAR) AS queue_date, CAST(doctor_id AS BIGINT) AS doctor_id,
       CAST(row_number() OVER (PARTITION BY queue_date, doctor_id ORDER BY
            CASE status WHEN 'consulting' THEN 1 WHEN 'waiting' THEN 2 WHEN 'completed' THEN 3
                        WHEN 'cancelled' THEN 4 ELSE 5 END, expected_sod NULLS FIRST, id) AS BIGINT)
         AS list_order,
       CAST(id AS BIGINT) AS id, token_number, patient_name, COALESCE(token_type, type, 'walkin') AS type,
       status, CAST(expected_sod AS BIGINT) AS expected_sod, {_hms('created_sod')} AS created_time,
       CAST(count(*) OVER (PARTITION BY queue_date, doctor_id) AS BIGINT) AS count
FROM tokens
"""


def _ampm(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN NULL ELSE printf('%02d:%02d %s', "
            f"CASE WHEN ({x} // 3600) % 12 = 0 THEN 12 ELSE ({x} // 3600) % 12 END, ({x} // 60) % 60, "
            f"CASE WHEN {x} // 3600 < 12 THEN 'AM' ELSE 'PM' END) END")


SQL["departments"] = ADAPTER + """
SELECT CAST(d.id AS BIGINT) AS id, d.name, d.description,
       CAST(row_number() OVER (ORDER BY d.name, d.id) AS BIGINT) AS name_order,
       CAST((SELECT count(*) FROM doctors x WHERE x.department_id = d.id) AS BIGINT) AS doctor_count
FROM departments d
"""

SQL["pharmacies_active"] = ADAPTER + """
SELECT CAST(id AS BIGINT) AS id, name, block, floor, wing,
       COALESCE(cash_counter, 'Counter A') AS cash_counter,
       COALESCE(online_counter, 'Counter 1') AS online_counter,
       concat('Block: ', COALESCE(block, ''), ', Floor: ', COALESCE(floor, ''), ', Wing: ', COALESCE(wing, ''))
         AS location,
       CAST((SELECT count(*) FROM pharmacy_staff s WHERE s.pharmacy_id = p.id) AS BIGINT) AS staff_count
FROM pharmacies p WHERE is_active
"""

SQL["doctor_locations"] = ADAPTER + """
SELECT CAST(id AS BIGINT) AS doctor_id, name AS doctor_name,
       COALESCE(floor_block, '') AS floor_block, COALESCE(wing, '') AS wing,
       COALESCE(room_number, '') AS room_number,
       concat_ws(', ', NULLIF(floor_block, ''), NULLIF(wing, ''), NULLIF(room_number, '')) AS location_text
FROM doctors
"""

SQL["doctor_directory"] = ADAPTER + """
SELECT CAST(d.id AS BIGINT) AS id, d.name, CAST(d.fees AS BIGINT) AS fees, dep.name AS department,
       CAST(dep.id AS BIGINT) AS department_id, d.floor_block, d.wing, d.room_number,
       CAST(row_number() OVER (PARTITION BY dep.name ORDER BY d.name, d.id) AS BIGINT) AS name_order
FROM doctors d JOIN departments dep ON d.department_id = dep.id
"""

SQL["tokens_enriched"] = ADAPTER + f"""
SELECT CAST(t.id AS BIGINT) AS id, t.token_number, t.patient_name, t.patient_phone, t.status, t.type,
       CAST(t.doctor_id AS BIGINT) AS doctor_id, CAST(t.department_id AS BIGINT) AS department_id,
       CAST(t.queue_date AS VARCHAR) AS queue_date,
       {_ampm('t.expected_sod')} AS expected_time, {_ampm('t.created_sod')} AS created_time,
       d.name AS doctor_name, dep.name AS department_name,
       CAST(row_number() OVER (PARTITION BY t.queue_date ORDER BY t.created_at, t.id) AS BIGINT) AS day_order
FROM tokens t LEFT JOIN doctors d ON t.doctor_id = d.id LEFT JOIN departments dep ON t.department_id = dep.id
"""

SQL["pharmacy_queue"] = ADAPTER + f"""
SELECT CAST(pt.id AS BIGINT) AS id, pt.token_number, pt.patient_name, pt.patient_phone, pt.status,
       pt.payment_method, CAST(pt.pharmacy_id AS BIGINT) AS pharmacy_id, p.name AS pharmacy_name,
       p.block, p.floor, p.wing, CAST(pt.queue_date AS VARCHAR) AS queue_date,
       {_ampm('pt.created_sod')} AS created_time,
       CAST(row_number() OVER (PARTITION BY pt.queue_date, pt.pharmacy_id ORDER BY pt.created_at, pt.id)
            AS BIGINT) AS position
FROM pharmacy_tokens pt JOIN pharmacies p ON pt.pharmacy_id = p.id
"""

SQL["view_lab_queue"] = ADAPTER + """
SELECT CAST(lt.token_id AS BIGINT) AS token_id, lt.token_number, t.test_name, lt.patient_name,
       lt.patient_type, CAST(lt.scheduled_sod AS BIGINT) AS scheduled_sod, lt.token_status,
       CAST(lt.queue_position AS BIGINT) AS queue_position, CAST(lt.scheduled_date AS VARCHAR) AS queue_date
FROM lab_tokens lt JOIN lab_tests t ON lt.test_id = t.test_id
WHERE lt.token_status IN ('waiting', 'in_progress')
"""

SQL["view_prebooked_labs"] = ADAPTER + """
SELECT CAST(p.booking_id AS BIGINT) AS booking_id, p.booking_code, t.test_name, t.test_code, p.patient_name,
       p.patient_phone, CAST(p.appointment_sod AS BIGINT) AS appointment_sod, p.booking_status,
       CAST(p.appointment_date AS VARCHAR) AS queue_date,
       CAST(row_number() OVER (PARTITION BY p.appointment_date ORDER BY p.appointment_sod, p.booking_id)
            AS BIGINT) AS time_order
FROM prebooked_lab_appointments p JOIN lab_tests t ON p.test_id = t.test_id
"""

SQL["lab_bookings_ordered"] = ADAPTER + """
SELECT CAST(p.booking_id AS BIGINT) AS booking_id, p.booking_code, CAST(p.test_id AS BIGINT) AS test_id,
       t.test_name, p.patient_name, CAST(p.appointment_date AS VARCHAR) AS appointment_date,
       CAST(p.appointment_sod AS BIGINT) AS appointment_sod, p.booking_status,
       CAST(row_number() OVER (PARTITION BY p.test_id
                               ORDER BY p.appointment_date, p.appointment_sod, p.booking_id) AS BIGINT)
         AS list_order
FROM prebooked_lab_appointments p JOIN lab_tests t ON p.test_id = t.test_id
"""

SQL["doctor_wait"] = ADAPTER + """
SELECT CAST(c.doctor_id AS BIGINT) AS doctor_id, CAST(c.queue_date AS VARCHAR) AS queue_date,
       CAST(c.n AS BIGINT) AS patients_waiting, d.name AS doctor_name,
       CAST(d.department_id AS BIGINT) AS department_id, CAST(c.n * 10 AS BIGINT) AS wait_time
FROM (SELECT doctor_id, queue_date, count(*) FILTER (WHERE status = 'waiting') AS n
      FROM tokens GROUP BY doctor_id, queue_date) c
JOIN doctors d ON d.id = c.doctor_id
"""

SQL["doctor_idle"] = ADAPTER + """,
span AS (SELECT min(queue_date) AS first, max(queue_date) AS last FROM tokens),
grid AS (
  SELECT d.id, d.name, d.department_id, CAST(g.day AS DATE) AS day,
         NOT EXISTS (SELECT 1 FROM tokens t WHERE t.doctor_id = d.id AND t.queue_date = CAST(g.day AS DATE)
                     AND t.status = 'waiting') AS idle
  FROM doctors d, (SELECT unnest(generate_series(first, last, INTERVAL 1 DAY)) AS day FROM span) g),
runs AS (
  SELECT *, day - CAST(row_number() OVER (PARTITION BY id ORDER BY day) AS INTEGER) AS island FROM grid WHERE idle)
SELECT CAST(id AS BIGINT) AS doctor_id, any_value(name) AS doctor_name, CAST(any_value(department_id) AS BIGINT) AS department_id,
       CAST(min(day) AS VARCHAR) AS idle_from, CAST(max(day) AS VARCHAR) AS idle_to, CAST(count(*) AS BIGINT) AS idle_days,
       CAST(0 AS BIGINT) AS wait_time
FROM runs GROUP BY id, island
"""

SQL["opd_stats"] = ADAPTER + """
SELECT CAST(queue_date AS VARCHAR) AS queue_date, CAST(doctor_id AS BIGINT) AS doctor_id,
       CAST(count(*) AS BIGINT) AS total,
       CAST(count(*) FILTER (WHERE status = 'waiting') AS BIGINT) AS waiting,
       CAST(count(*) FILTER (WHERE status = 'consulting') AS BIGINT) AS consulting,
       CAST(count(*) FILTER (WHERE status = 'completed') AS BIGINT) AS completed,
       CAST(count(*) FILTER (WHERE status = 'cancelled') AS BIGINT) AS cancelled
FROM tokens GROUP BY queue_date, doctor_id
"""

SQL["pharmacy_stats"] = ADAPTER + """
SELECT CAST(queue_date AS VARCHAR) AS queue_date, CAST(pharmacy_id AS BIGINT) AS pharmacy_id,
       CAST(count(*) AS BIGINT) AS total,
       CAST(count(*) FILTER (WHERE status = 'waiting') AS BIGINT) AS waiting,
       CAST(count(*) FILTER (WHERE status = 'processing') AS BIGINT) AS processing,
       CAST(count(*) FILTER (WHERE status = 'completed') AS BIGINT) AS completed,
       CAST(count(*) FILTER (WHERE status = 'cancelled') AS BIGINT) AS cancelled
FROM pharmacy_tokens GROUP BY queue_date, pharmacy_id
"""

SQL["department_wait"] = ADAPTER + """
SELECT CAST(queue_date AS VARCHAR) AS queue_date, CAST(department_id AS BIGINT) AS department_id,
       CAST(count(*) FILTER (WHERE status = 'waiting') AS BIGINT) AS waiting,
       CAST(10 * count(*) FILTER (WHERE status = 'waiting') AS BIGINT) AS wait_minutes
FROM tokens GROUP BY queue_date, department_id
"""

SQL["daily_issued"] = ADAPTER + """
SELECT CAST(queue_date AS VARCHAR) AS queue_date, CAST(department_id AS BIGINT) AS department_id,
       CAST(count(*) AS BIGINT) AS issued, CAST(count(*) + 1 AS BIGINT) AS next_sequence
FROM tokens GROUP BY queue_date, department_id
"""

SQL["lab_wait"] = ADAPTER + """
SELECT CAST(a.test_id AS BIGINT) AS test_id, CAST(a.queue_date AS VARCHAR) AS queue_date,
       CAST(a.issued AS BIGINT) AS issued, CAST(a.active AS BIGINT) AS active, t.test_code,
       CAST(a.active * t.slot_duration AS BIGINT) AS wait_minutes
FROM (SELECT scheduled_date AS queue_date, test_id, count(*) AS issued,
             count(*) FILTER (WHERE token_status IN ('waiting', 'in_progress')) AS active
      FROM lab_tokens GROUP BY scheduled_date, test_id) a
JOIN lab_tests t ON t.test_id = a.test_id
"""

SQL["pharmacy_wait"] = ADAPTER + """
SELECT CAST(queue_date AS VARCHAR) AS queue_date, CAST(pharmacy_id AS BIGINT) AS pharmacy_id,
       CAST(count(*) AS BIGINT) AS issued,
       CAST(count(*) FILTER (WHERE status = 'waiting') AS BIGINT) AS waiting,
       CAST(3 * count(*) FILTER (WHERE status = 'waiting') AS BIGINT) AS wait_minutes
FROM pharmacy_tokens GROUP BY queue_date, pharmacy_id
"""

SQL["current_tokens"] = ADAPTER + """
SELECT 'day' AS scope, CAST(t.queue_date AS VARCHAR) AS queue_date, CAST(NULL AS BIGINT) AS scope_id,
       t.token_number AS current_token, d.name AS doctor_name, p.name AS department_name
FROM tokens t LEFT JOIN doctors d ON d.id = t.doctor_id LEFT JOIN departments p ON p.id = t.department_id
WHERE t.id IN (SELECT min(id) FROM tokens WHERE status = 'consulting' GROUP BY queue_date)
UNION ALL
SELECT 'department', CAST(queue_date AS VARCHAR), CAST(department_id AS BIGINT),
       COALESCE(arg_min(token_number, id) FILTER (WHERE status = 'consulting'), 'None'), NULL, NULL
FROM tokens GROUP BY queue_date, department_id
UNION ALL
SELECT 'pharmacy', CAST(queue_date AS VARCHAR), CAST(pharmacy_id AS BIGINT),
       arg_min(token_number, (created_at, id)), NULL, NULL
FROM pharmacy_tokens WHERE status = 'processing' GROUP BY queue_date, pharmacy_id
"""

SQL["bookings_per_test"] = ADAPTER + """
SELECT CAST(p.test_id AS BIGINT) AS test_id, CAST(p.appointment_date AS VARCHAR) AS queue_date,
       CAST(count(*) AS BIGINT) AS total_bookings, t.test_name
FROM prebooked_lab_appointments p JOIN lab_tests t ON p.test_id = t.test_id
GROUP BY p.test_id, p.appointment_date, t.test_name
"""

SQL["lab_capacity"] = ADAPTER + """
SELECT CAST(p.test_id AS BIGINT) AS test_id, CAST(p.appointment_date AS VARCHAR) AS slot_date,
       CAST(count(*) AS BIGINT) AS booked_count, t.test_code, CAST(t.daily_capacity AS BIGINT) AS total_capacity,
       CAST(t.daily_capacity - count(*) AS BIGINT) AS available_count
FROM prebooked_lab_appointments p JOIN lab_tests t ON p.test_id = t.test_id
WHERE p.booking_status <> 'cancelled'
GROUP BY p.test_id, p.appointment_date, t.test_code, t.daily_capacity
"""

SQL["slot_availability"] = ADAPTER + """,
live AS (
  SELECT p.test_id, p.appointment_date AS day, p.appointment_sod // (60 * t.slot_duration) AS slot
  FROM prebooked_lab_appointments p JOIN lab_tests t ON t.test_id = p.test_id WHERE p.booking_status <> 'cancelled'),
calendar AS (
  SELECT t.test_id, t.test_code, x.day, t.daily_capacity AS c, 1440 // t.slot_duration AS n, t.slot_duration AS w,
         unnest(range(0, 1440 // t.slot_duration)) AS slot
  FROM lab_tests t JOIN (SELECT DISTINCT test_id, day FROM live) x ON x.test_id = t.test_id),
filled AS (
  SELECT k.*, (SELECT count(*) FROM live l WHERE l.test_id = k.test_id AND l.day = k.day AND l.slot = k.slot) AS booked
  FROM calendar k),
shared AS (
  SELECT *, c // n + CASE WHEN row_number() OVER (PARTITION BY test_id, day ORDER BY booked DESC, slot) <= c % n
                          THEN 1 ELSE 0 END AS total FROM filled)
SELECT CAST(test_id AS BIGINT) AS test_id, test_code, CAST(day AS VARCHAR) AS slot_date,
       printf('%02d:%02d:00', slot * w // 60, slot * w % 60) AS slot_time, CAST(slot * w * 60 AS BIGINT) AS slot_sod,
       CAST(total AS BIGINT) AS total_capacity, CAST(booked AS BIGINT) AS booked_count,
       CAST(total - booked AS BIGINT) AS available_count
FROM shared
"""

SQL["queue_totals"] = ADAPTER + _LIVE_ROWS + """,
lq AS (SELECT queue_date, doctor_id, count(*) AS n FROM lq_rows GROUP BY ALL),
wl AS (SELECT queue_date, doctor_id, count(*) AS n FROM tokens
       WHERE status IN ('waiting', 'consulting') GROUP BY ALL),
ea AS (SELECT appointment_date AS queue_date, doctor_id, count(*) AS n
       FROM prebooked_appointments pb
       WHERE pb.status IN ('booked', 'confirmed') AND NOT EXISTS (
         SELECT 1 FROM tokens t
         WHERE (upper(trim(t.token_number)) = upper(trim(pb.booking_id))
                OR upper(trim(t.booking_id)) = upper(trim(pb.booking_id)))
           AND t.queue_date = pb.appointment_date AND t.status <> 'cancelled')
       GROUP BY ALL),
ct AS (SELECT queue_date, doctor_id, count(*) AS n FROM tokens GROUP BY ALL),
k AS (SELECT queue_date, doctor_id FROM lq UNION SELECT queue_date, doctor_id FROM wl
      UNION SELECT queue_date, doctor_id FROM ea UNION SELECT queue_date, doctor_id FROM ct)
SELECT CAST(k.queue_date AS VARCHAR) AS queue_date, CAST(k.doctor_id AS BIGINT) AS doctor_id,
       CAST(COALESCE(lq.n, 0) AS BIGINT) AS total_in_queue, CAST(COALESCE(wl.n, 0) AS BIGINT) AS total_waiting,
       CAST(COALESCE(ea.n, 0) AS BIGINT) AS total_expected, CAST(COALESCE(ct.n, 0) AS BIGINT) AS count,
       CAST(least(COALESCE(wl.n, 0), 20) AS BIGINT) AS waiting_shown,
       CAST(least(COALESCE(ea.n, 0), 10) AS BIGINT) AS expected_shown
FROM k
LEFT JOIN lq ON lq.queue_date = k.queue_date AND lq.doctor_id IS NOT DISTINCT FROM k.doctor_id
LEFT JOIN wl ON wl.queue_date = k.queue_date AND wl.doctor_id IS NOT DISTINCT FROM k.doctor_id
LEFT JOIN ea ON ea.queue_date = k.queue_date AND ea.doctor_id IS NOT DISTINCT FROM k.doctor_id
LEFT JOIN ct ON ct.queue_date = k.queue_date AND ct.doctor_id IS NOT DISTINCT FROM k.doctor_id
"""

SQL["doctor_remaining"] = ADAPTER + """,
w AS (
  SELECT queue_date, doctor_id, status,
         row_number() OVER (PARTITION BY queue_date, doctor_id ORDER BY
           CASE WHEN status = 'consulting' THEN 0 ELSE 1 END,
           CASE WHEN status = 'consulting' THEN 0
                WHEN COALESCE(token_type, type) = 'prebooked' OR upper(token_number) LIKE 'PB%' THEN 1
                WHEN COALESCE(token_type, type) = 'review' THEN 2 ELSE 3 END,
           expected_sod NULLS FIRST, id) AS position
  FROM tokens WHERE status IN ('waiting', 'consulting')),
g AS (
  SELECT queue_date, doctor_id, count(*) AS total,
         COALESCE(min(position) FILTER (WHERE status = 'consulting'), 1) - 1 AS idx
  FROM w GROUP BY queue_date, doctor_id),
r AS (SELECT *, greatest(0, total - (idx + 1)) AS remaining FROM g)
SELECT CAST(queue_date AS VARCHAR) AS queue_date, CAST(doctor_id AS BIGINT) AS doctor_id,
       CAST(total AS BIGINT) AS total, CAST(idx AS BIGINT) AS current_index,
       CAST(remaining AS BIGINT) AS remaining,
       CASE WHEN total = 0 THEN 'No tokens in queue' WHEN remaining <= 0 THEN 'Last patient in queue'
            ELSE concat(CAST(remaining AS VARCHAR), ' more token', CASE WHEN remaining <> 1 THEN 's' ELSE '' END,
                        ' waiting') END AS queue_status
FROM r
"""


_ACT = """,
act AS (
  SELECT 'opd' AS token_type, 0 AS kind_rank, t.id, t.token_number, t.status AS token_status, t.patient_id,
         t.patient_phone, t.queue_date, (SELECT d.name FROM doctors d WHERE d.id = t.doctor_id) AS location_name
  FROM tokens t WHERE t.status IN ('waiting', 'consulting')
  UNION ALL
  SELECT 'lab', 1, lt.token_id, lt.token_number, lt.token_status, lt.patient_id, lt.patient_phone,
         lt.scheduled_date, (SELECT x.test_name FROM lab_tests x WHERE x.test_id = lt.test_id)
  FROM lab_tokens lt WHERE lt.token_status IN ('waiting', 'in_progress')),
req AS (
  SELECT req_id, d, patient_id, patient_phone,
         CASE WHEN patient_id IS NOT NULL THEN 'patient_id'
              WHEN COALESCE(trim(patient_phone), '') <> '' THEN 'phone' ELSE 'none' END AS key_kind
  FROM lookup_log),
m AS (
  SELECT r.req_id, a.token_type, a.token_number, a.token_status, a.location_name,
         row_number() OVER (PARTITION BY r.req_id ORDER BY a.kind_rank, a.id) AS rn
  FROM req r JOIN act a ON a.queue_date = r.d
   AND ((r.key_kind = 'patient_id' AND a.patient_id = r.patient_id)
        OR (r.key_kind = 'phone' AND a.patient_phone = r.patient_phone)))
"""

SQL["active_tokens"] = ADAPTER + _ACT + """
SELECT token_type, CAST(id AS BIGINT) AS id, token_number, token_status, CAST(patient_id AS BIGINT) AS patient_id,
       patient_phone, CAST(queue_date AS VARCHAR) AS queue_date, location_name
FROM act
"""

SQL["active_token_by_patient"] = ADAPTER + _ACT + """
SELECT CAST(r.req_id AS BIGINT) AS req_id, r.key_kind, m.req_id IS NOT NULL AS found, m.token_type,
       m.token_number, m.token_status, m.location_name
FROM req r LEFT JOIN m ON m.req_id = r.req_id AND m.rn = 1
"""

SQL["admission"] = ADAPTER + _ACT + """
SELECT CAST(r.req_id AS BIGINT) AS req_id, m.req_id IS NULL AS allowed, m.token_number AS existing_token,
       CASE WHEN m.req_id IS NULL THEN NULL
            WHEN r.key_kind = 'patient_id' THEN
              'You already have an active ' || CASE WHEN m.token_type = 'opd' THEN 'OPD consultation' ELSE 'Lab test' END
              || ' token (' || m.token_number || ') from your account. Only one token per account is allowed. '
              || 'Please complete, cancel, or wait for it to expire.'
            ELSE
              'You already have an active ' || CASE WHEN m.token_type = 'opd' THEN 'OPD consultation' ELSE 'Lab test' END
              || ' token (' || m.token_number || '). You can only have one token at a time. '
              || 'Please complete, cancel, or wait for it to expire.' END AS message
FROM req r LEFT JOIN m ON m.req_id = r.req_id AND m.rn = 1
"""

SQL["token_status"] = ADAPTER + """,
req AS (
  SELECT req_id, d, upper(trim(token)) AS T,
         upper(trim(CASE WHEN req_id % 4 = 1 THEN booking_id ELSE '' END)) AS B
  FROM lookup_log),
tk AS (
  SELECT t.id, t.token_number, t.booking_id, t.status, t.queue_date, d.name AS doctor_name,
         dep.name AS department_name, d.floor_block, d.wing, d.room_number
  FROM tokens t LEFT JOIN doctors d ON t.doctor_id = d.id LEFT JOIN departments dep ON t.department_id = dep.id),
s1 AS (
  SELECT r.req_id, tk.*, row_number() OVER (PARTITION BY r.req_id ORDER BY tk.id) AS rn
  FROM req r JOIN tk ON (upper(trim(tk.token_number)) = r.T OR upper(trim(tk.booking_id)) = r.T)
                    AND tk.queue_date = r.d
  WHERE r.T <> ''),
s2 AS (
  SELECT r.req_id, pa.status, pa.booking_id, d.name AS doctor_name, dep.name AS department_name
  FROM req r JOIN prebooked_appointments pa ON upper(trim(pa.booking_id)) = r.B
  LEFT JOIN doctors d ON pa.doctor_id = d.id LEFT JOIN departments dep ON pa.department_id = dep.id
  WHERE r.B <> ''),
s3 AS (
  SELECT r.req_id, tk.*, row_number() OVER (PARTITION BY r.req_id ORDER BY tk.id) AS rn
  FROM req r JOIN tk ON upper(trim(tk.booking_id)) = r.B AND tk.queue_date = r.d
  WHERE r.B <> ''),
j AS (
  SELECT r.req_id, r.T, r.B,
         s1.req_id IS NOT NULL AS h1, s2.req_id IS NOT NULL AS h2, s3.req_id IS NOT NULL AS h3,
         s1.status AS st1, s2.status AS st2, s3.status AS st3,
         s1.token_number AS tn1, s3.token_number AS tn3,
         s1.booking_id AS b1, s2.booking_id AS b2, s3.booking_id AS b3,
         s1.doctor_name AS dn1, s2.doctor_name AS dn2, s3.doctor_name AS dn3,
         s1.department_name AS dp1, s2.department_name AS dp2, s3.department_name AS dp3,
         s1.floor_block, s1.wing, s1.room_number
  FROM req r LEFT JOIN s1 ON s1.req_id = r.req_id AND s1.rn = 1
  LEFT JOIN s2 ON s2.req_id = r.req_id
  LEFT JOIN s3 ON s3.req_id = r.req_id AND s3.rn = 1)
SELECT CAST(req_id AS BIGINT) AS req_id,
       CASE WHEN T = '' AND B = '' THEN NULL ELSE COALESCE(st1, st2, st3, 'not_found') END AS status,
       CASE WHEN COALESCE(st1, st2, st3) = 'cancelled' THEN 'due to being late' END AS reason,
       CASE WHEN h1 THEN tn1 WHEN h2 THEN NULL WHEN h3 THEN tn3 END AS token_number,
       CASE WHEN h1 THEN COALESCE(b1, B) WHEN h2 THEN b2 WHEN h3 THEN b3 END AS booking_id,
       CASE WHEN h1 THEN dn1 WHEN h2 THEN dn2 WHEN h3 THEN dn3 END AS doctor_name,
       CASE WHEN h1 THEN dp1 WHEN h2 THEN dp2 WHEN h3 THEN dp3 END AS department_name,
       CASE WHEN h1 THEN COALESCE(floor_block, '') WHEN h2 OR h3 THEN '' END AS floor_block,
       CASE WHEN h1 THEN COALESCE(wing, '') WHEN h2 OR h3 THEN '' END AS wing,
       CASE WHEN h1 THEN COALESCE(room_number, '') WHEN h2 OR h3 THEN '' END AS room_number,
       CAST(CASE WHEN h1 THEN 1 WHEN h2 THEN 2 WHEN h3 THEN 3 END AS BIGINT) AS step
FROM j
"""

SQL["verify_bookings"] = ADAPTER + f""",
b AS (
  SELECT pb.*, d.name AS doctor_name, d.fees AS doctor_fees, d.floor_block, d.wing, d.room_number,
         dep.name AS department_name
  FROM prebooked_appointments pb JOIN doctors d ON pb.doctor_id = d.id
  JOIN departments dep ON pb.department_id = dep.id
  WHERE pb.status IN ('booked', 'confirmed'))
SELECT CAST(r.req_id AS BIGINT) AS req_id, b.booking_id IS NOT NULL AS found, b.booking_id, b.patient_name,
       b.patient_phone, strftime(b.appointment_date, '%d %b %Y') AS appointment_date,
       {_hms('b.appointment_sod')} AS appointment_time, b.status, CAST(b.doctor_id AS BIGINT) AS doctor_id,
       b.doctor_name, CAST(b.doctor_fees AS BIGINT) AS doctor_fees, b.floor_block, b.wing, b.room_number,
       CAST(b.department_id AS BIGINT) AS department_id, b.department_name
FROM lookup_log r LEFT JOIN b ON upper(trim(b.booking_id)) = upper(trim(r.booking_id)) AND b.appointment_date >= r.d
"""

SQL["booking_ahead"] = ADAPTER + f""",
a AS (
  SELECT v.*,
    (SELECT count(*) FROM tokens t
      WHERE t.doctor_id = v.doctor_id AND t.queue_date = v.appointment_date
        AND t.status IN ('waiting', 'consulting')
        AND (t.token_type = 'prebooked' OR upper(t.token_number) LIKE 'PB%')
        AND COALESCE(t.expected_sod, t.created_sod) < v.appointment_sod)
    + (SELECT count(*) FROM prebooked_appointments p
        WHERE p.doctor_id = v.doctor_id AND p.appointment_date = v.appointment_date AND p.status = 'booked'
          AND p.appointment_sod < v.appointment_sod AND p.booking_id <> v.booking_id) AS ahead
  FROM prebooked_appointments v WHERE v.status IN ('booked', 'confirmed'))
SELECT CAST(id AS BIGINT) AS id, booking_id, CAST(doctor_id AS BIGINT) AS doctor_id,
       CAST(appointment_date AS VARCHAR) AS queue_date, {_hms('appointment_sod')} AS appointment_time,
       CAST(ahead AS BIGINT) AS patients_ahead, CAST(ahead * 10 AS BIGINT) AS wait_time
FROM a
"""

_LAB_AHEAD = """(SELECT count(*) FROM lab_tokens lt
      WHERE lt.test_id = {v}.test_id AND lt.scheduled_date = {day} AND lt.token_status IN ('waiting', 'in_progress'))
    + (SELECT count(*) FROM prebooked_lab_appointments p2
        WHERE p2.test_id = {v}.test_id AND p2.appointment_date = {day} AND p2.booking_status = 'booked'
          AND p2.appointment_sod < {v}.appointment_sod AND p2.booking_code <> {v}.booking_code)"""

SQL["lab_booking_ahead"] = ADAPTER + f""",
v AS (
  SELECT p.*, t.test_code, t.duration_minutes FROM prebooked_lab_appointments p JOIN lab_tests t ON p.test_id = t.test_id
  WHERE p.booking_status IN ('booked', 'checked_in', 'in_progress')),
a AS (SELECT v.*, {_LAB_AHEAD.format(v='v', day='v.appointment_date')} AS ahead FROM v)
SELECT CAST(booking_id AS BIGINT) AS booking_id, booking_code, CAST(test_id AS BIGINT) AS test_id, test_code,
       CAST(appointment_date AS VARCHAR) AS queue_date, {_hms('appointment_sod')} AS scheduled_time,
       CAST(ahead AS BIGINT) AS people_ahead, CAST(ahead * duration_minutes AS BIGINT) AS wait_time,
       {_hms('((appointment_sod + ahead * duration_minutes * 60) % 86400)')} AS expected_time,
       CAST(ahead + 1 AS BIGINT) AS position
FROM a
"""

SQL["verify_lab_bookings"] = ADAPTER + f""",
x AS (
  SELECT r.req_id, r.d, r.patient_id AS who, p.*, t.test_code, t.test_name, t.duration_minutes
  FROM lookup_log r JOIN prebooked_lab_appointments p
    ON p.booking_code = upper(trim(r.lab_code)) AND p.appointment_date >= r.d
   AND p.booking_status IN ('booked', 'checked_in', 'in_progress')
  JOIN lab_tests t ON p.test_id = t.test_id),
now_active AS (
  SELECT 'OPD consultation' AS name, 0 AS lab, id, token_number, patient_id, patient_phone, queue_date
  FROM tokens WHERE status IN ('waiting', 'consulting')
  UNION ALL SELECT 'Lab test', 1, token_id, token_number, patient_id, patient_phone, scheduled_date
  FROM lab_tokens WHERE token_status IN ('waiting', 'in_progress')),
hit AS (
  SELECT x.req_id, x.who, n.name, n.token_number,
         row_number() OVER (PARTITION BY x.req_id ORDER BY n.lab, n.id) AS k
  FROM x JOIN now_active n ON n.queue_date = x.d
   AND CASE WHEN x.who IS NOT NULL THEN n.patient_id = x.who ELSE n.patient_phone = x.patient_phone END),
a AS (SELECT x.*, {_LAB_AHEAD.format(v='x', day='x.d')} AS ahead FROM x
      WHERE x.req_id NOT IN (SELECT req_id FROM hit))
SELECT CAST(q.req_id AS BIGINT) AS req_id, booking_code AS booking_id, CAST(test_id AS BIGINT) AS test_id, test_code,
       test_name, a.patient_name, a.patient_phone, CAST(appointment_date AS VARCHAR) AS appointment_date,
       {_hms('appointment_sod')} AS scheduled_time,
       {_hms('((appointment_sod + ahead * duration_minutes * 60) % 86400)')} AS expected_time,
       booking_status, CAST(ahead AS BIGINT) AS people_ahead, CAST(ahead * duration_minutes AS BIGINT) AS wait_time,
       CAST(ahead + 1 AS BIGINT) AS position, a.req_id IS NOT NULL AS found,
       CASE WHEN h.req_id IS NOT NULL THEN concat('You already have an active ', h.name, ' token (', h.token_number,
              CASE WHEN h.who IS NOT NULL THEN ') from your account. Only one token per account is allowed. '
                   ELSE '). You can only have one token at a time. ' END,
              'Please complete, cancel, or wait for it to expire before checking in.')
            WHEN a.req_id IS NULL
            THEN 'Booking not found or already completed. Please check your Lab Booking ID.' END AS message
FROM lookup_log q LEFT JOIN a ON a.req_id = q.req_id LEFT JOIN hit h ON h.req_id = q.req_id AND h.k = 1
"""


def _sod(ts: str) -> str:
    return f"(hour({ts})*3600 + minute({ts})*60 + second({ts}))"


def _intval(x: str) -> str:
    return f"COALESCE(TRY_CAST(NULLIF(regexp_extract({x}, '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT), 0)"


def _initial(x: str) -> str:
    return (f"CASE WHEN upper(substr(COALESCE({x}, ''), 1, 1)) = '' THEN 'T' "
            f"ELSE upper(substr(COALESCE({x}, ''), 1, 1)) END")


def _depth(arr: str, upd: str, group: str, active: str) -> str:
    """CTEs ``dl``/``dp``: depth at arrival for arrivals ``arr`` (token_id, ts,
    group cols) and status requests ``upd`` (req_id, token_id, ts, new_status)."""
    return f""",
ev_{arr} AS (
  SELECT token_id, ts, {group}, 0 AS k, token_id AS s, 1 AS act FROM {arr}
  UNION ALL
  SELECT u.token_id, u.ts, {', '.join('a.' + g.strip() for g in group.split(','))}, 1, u.req_id,
         CASE WHEN u.new_status IN ({active}) THEN 1 ELSE 0 END
  FROM {upd} u JOIN {arr} a ON a.token_id = u.token_id),
dl_{arr} AS (
  SELECT *, act - COALESCE(lag(act) OVER (PARTITION BY token_id ORDER BY ts, k, s), 0) AS delta FROM ev_{arr}),
dp_{arr} AS (
  SELECT token_id, COALESCE(sum(delta) OVER (PARTITION BY {group} ORDER BY ts, k, s
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM dl_{arr} WHERE TRUE QUALIFY k = 0)
"""


SQL["opd_token_numbers"] = ADAPTER + f"""
SELECT CAST(t.id AS BIGINT) AS id, CAST(t.queue_date AS VARCHAR) AS queue_date,
       CAST(t.department_id AS BIGINT) AS department_id, CAST(row_number() OVER w AS BIGINT) AS sequence,
       concat({_initial('dp.name')}, printf('%03d', row_number() OVER w)) AS issued_number
FROM tokens t JOIN departments dp ON dp.id = t.department_id
WINDOW w AS (PARTITION BY t.department_id, t.queue_date ORDER BY t.created_at, t.id)
"""

SQL["lab_token_numbers"] = ADAPTER + """
SELECT CAST(lt.token_id AS BIGINT) AS token_id, CAST(lt.scheduled_date AS VARCHAR) AS queue_date,
       CAST(lt.test_id AS BIGINT) AS test_id, CAST(row_number() OVER w AS BIGINT) AS sequence,
       concat(t.test_code, '-', printf('%03d', row_number() OVER w)) AS issued_number
FROM lab_tokens lt JOIN lab_tests t ON t.test_id = lt.test_id
WINDOW w AS (PARTITION BY lt.test_id, lt.scheduled_date ORDER BY lt.created_at, lt.token_id)
"""

SQL["pharmacy_token_numbers"] = ADAPTER + """
SELECT CAST(id AS BIGINT) AS id, CAST(queue_date AS VARCHAR) AS queue_date, CAST(pharmacy_id AS BIGINT) AS pharmacy_id,
       CAST(row_number() OVER w AS BIGINT) AS sequence,
       concat('PH', CAST(pharmacy_id AS VARCHAR), '-', printf('%03d', row_number() OVER w)) AS issued_number
FROM pharmacy_tokens
WINDOW w AS (PARTITION BY pharmacy_id, queue_date ORDER BY created_at, id)
"""

_ARRIVALS = """,
a_opd AS (SELECT id AS token_id, created_at AS ts, department_id AS group_id, queue_date FROM tokens),
a_lab AS (SELECT token_id, created_at AS ts, test_id AS group_id, scheduled_date AS queue_date FROM lab_tokens),
a_ph AS (SELECT id AS token_id, created_at AS ts, pharmacy_id AS group_id, queue_date FROM pharmacy_tokens)"""

_DEPTHS = (_ARRIVALS + _depth("a_opd", "status_log", "group_id, queue_date", "'waiting'")
           + _depth("a_lab", "lab_status_log", "group_id, queue_date", "'waiting', 'in_progress'")
           + _depth("a_ph", "pharmacy_status_log", "group_id, queue_date", "'waiting'"))

SQL["depth_at_arrival"] = ADAPTER + _DEPTHS + """
SELECT 'opd' AS kind, CAST(a.token_id AS BIGINT) AS token_id, CAST(a.queue_date AS VARCHAR) AS queue_date,
       CAST(a.group_id AS BIGINT) AS group_id, CAST(d.ahead AS BIGINT) AS patients_ahead,
       CAST(d.ahead * 10 AS BIGINT) AS wait_minutes
FROM a_opd a JOIN dp_a_opd d ON d.token_id = a.token_id
UNION ALL
SELECT 'lab', CAST(a.token_id AS BIGINT), CAST(a.queue_date AS VARCHAR), CAST(a.group_id AS BIGINT),
       CAST(d.ahead AS BIGINT), CAST(d.ahead * t.slot_duration AS BIGINT)
FROM a_lab a JOIN dp_a_lab d ON d.token_id = a.token_id JOIN lab_tests t ON t.test_id = a.group_id
UNION ALL
SELECT 'pharmacy', CAST(a.token_id AS BIGINT), CAST(a.queue_date AS VARCHAR), CAST(a.group_id AS BIGINT),
       CAST(d.ahead AS BIGINT), CAST(d.ahead * 3 AS BIGINT)
FROM a_ph a JOIN dp_a_ph d ON d.token_id = a.token_id
"""

SQL["expected_times"] = ADAPTER + _ARRIVALS + _depth("a_opd", "status_log", "group_id, queue_date", "'waiting'") + f""",
e AS (SELECT t.id, t.queue_date, d.ahead, (t.created_sod + d.ahead * 600) % 86400 AS es
      FROM tokens t JOIN dp_a_opd d ON d.token_id = t.id)
SELECT CAST(id AS BIGINT) AS token_id, CAST(queue_date AS VARCHAR) AS queue_date, CAST(ahead AS BIGINT) AS patients_ahead,
       CAST(es AS BIGINT) AS expected_sod, {_hms('es')} AS expected_time, {_ampm('es')} AS expected_label
FROM e
"""

SQL["scalar_suite"] = ADAPTER + f""",
s AS (SELECT *, (created_sod + 600 * (id % 200)) % 86400 AS w FROM tokens)
SELECT CAST(id AS BIGINT) AS id, CAST(queue_date AS VARCHAR) AS queue_date, {_hms('created_sod')} AS created_time,
       {_ampm('created_sod')} AS created_label,
       printf('%d:%02d %s', CASE WHEN (created_sod // 3600) % 12 = 0 THEN 12 ELSE (created_sod // 3600) % 12 END,
              (created_sod // 60) % 60, CASE WHEN created_sod // 3600 < 12 THEN 'AM' ELSE 'PM' END) AS board_time,
       concat('T', printf('%03d', id)) AS padded, CAST(w AS BIGINT) AS wrapped_sod, {_hms('w')} AS wrapped_time,
       concat(upper(substr(status, 1, 1)), substr(status, 2)) AS status_title, upper(status) AS status_upper,
       strftime(queue_date, '%d %b %Y') AS day_label, upper(token_number) LIKE 'PB%' AS is_pb,
       regexp_matches(patient_phone, '^[0-9]{{10}}$') AS phone_ok,
       {_intval('substr(token_number, 2, 10)')} AS number_part
FROM s
"""

SQL["status_labels"] = ADAPTER + """,
u AS (SELECT 'opd' AS source, id, queue_date, status FROM tokens
      UNION ALL SELECT 'lab', token_id, scheduled_date, token_status FROM lab_tokens
      UNION ALL SELECT 'pharmacy', id, queue_date, status FROM pharmacy_tokens),
c AS (SELECT *, CASE WHEN status IS NULL OR status = '' THEN 'waiting'
                     ELSE CASE lower(status) WHEN 'waiting' THEN 'waiting' WHEN 'consulting' THEN 'inprogress'
                          WHEN 'in_progress' THEN 'inprogress' WHEN 'in progress' THEN 'inprogress'
                          WHEN 'completed' THEN 'completed' WHEN 'done' THEN 'completed'
                          WHEN 'skipped' THEN 'skipped' WHEN 'cancelled' THEN 'skipped' WHEN 'canceled' THEN 'skipped'
                          WHEN 'break' THEN 'break' WHEN 'on_break' THEN 'break' WHEN 'on break' THEN 'break'
                          ELSE lower(status) END END AS category FROM u),
l AS (SELECT *, CASE category WHEN 'waiting' THEN 'Waiting' WHEN 'inprogress' THEN 'In progress'
                     WHEN 'completed' THEN 'Completed' WHEN 'skipped' THEN 'Skipped' WHEN 'break' THEN 'On Break'
                     ELSE category END AS label,
                CASE category WHEN 'waiting' THEN 'status-waiting' WHEN 'inprogress' THEN 'status-inprogress'
                     WHEN 'completed' THEN 'status-completed' WHEN 'skipped' THEN 'status-skipped'
                     WHEN 'break' THEN 'status-break' ELSE 'status-waiting' END AS css_class FROM c)
SELECT source, CAST(id AS BIGINT) AS id, CAST(queue_date AS VARCHAR) AS queue_date, status, category, label, css_class,
       CASE source
         WHEN 'opd' THEN COALESCE(CASE status WHEN 'consulting' THEN 'In Process' WHEN 'waiting' THEN 'Waiting'
                                  WHEN 'completed' THEN 'Completed' WHEN 'cancelled' THEN 'Cancelled' END, 'Waiting')
         WHEN 'pharmacy' THEN COALESCE(CASE status WHEN 'waiting' THEN 'Waiting' WHEN 'processing' THEN 'Processing'
                                       WHEN 'completed' THEN 'Completed' WHEN 'cancelled' THEN 'Cancelled' END, status)
         ELSE label END AS board_label
FROM l
"""

SQL["queue_badges"] = "SELECT *, CASE WHEN is_you OR upper(shown_token) = upper(viewer_token) THEN 'YOU' " \
    "WHEN status = 'consulting' THEN 'In Consult' " \
    "WHEN token_type = 'prebooked' OR starts_with(shown_token, 'PB') THEN 'Booked' ELSE 'Walk-in' END AS badge " \
    "FROM (" + SQL["queue_neighbourhood"] + ") nb"

_PQ = """,
pq AS (SELECT pt.*, row_number() OVER (PARTITION BY pt.queue_date, pt.pharmacy_id ORDER BY pt.created_at, pt.id) AS position
       FROM pharmacy_tokens pt JOIN pharmacies p ON pt.pharmacy_id = p.id)"""

SQL["pharmacy_board"] = ADAPTER + _PQ + """,
q AS (SELECT *, row_number() OVER (PARTITION BY queue_date, pharmacy_id ORDER BY position, id) AS board_position
      FROM pq WHERE status <> 'cancelled'),
w AS (SELECT id, row_number() OVER (PARTITION BY queue_date, pharmacy_id ORDER BY position, id) AS waiting_position
      FROM q WHERE status = 'waiting'),
s AS (SELECT queue_date, pharmacy_id, arg_min(id, position) AS serving FROM q WHERE status = 'processing'
      GROUP BY queue_date, pharmacy_id)
SELECT CAST(q.queue_date AS VARCHAR) AS queue_date, CAST(q.pharmacy_id AS BIGINT) AS pharmacy_id, CAST(q.id AS BIGINT) AS id,
       q.token_number, q.status, CAST(q.board_position AS BIGINT) AS board_position,
       CAST(w.waiting_position AS BIGINT) AS waiting_position, COALESCE(q.id = s.serving, FALSE) AS now_serving
FROM q LEFT JOIN w ON w.id = q.id LEFT JOIN s ON s.queue_date = q.queue_date AND s.pharmacy_id = q.pharmacy_id
"""

SQL["pharmacy_next"] = ADAPTER + _PQ + """,
g AS (SELECT queue_date, pharmacy_id, count(*) FILTER (WHERE status = 'processing') AS processing,
             arg_min(id, position) FILTER (WHERE status = 'waiting') AS nxt
      FROM pq GROUP BY queue_date, pharmacy_id)
SELECT CAST(queue_date AS VARCHAR) AS queue_date, CAST(pharmacy_id AS BIGINT) AS pharmacy_id,
       CAST(processing AS BIGINT) AS processing,
       CASE WHEN processing > 0 THEN 'busy' WHEN nxt IS NULL THEN 'empty' ELSE 'call_next' END AS action,
       CAST(CASE WHEN processing = 0 AND nxt IS NOT NULL THEN nxt END AS BIGINT) AS next_token_id,
       CASE WHEN processing = 0 AND nxt IS NOT NULL THEN 'processing' END AS new_status
FROM g
"""

SQL["next_patient"] = ADAPTER + """,
r AS (
  SELECT *, row_number() OVER (PARTITION BY queue_date, doctor_id ORDER BY
            CASE WHEN status = 'consulting' THEN 0 ELSE 1 END,
            CASE WHEN status = 'consulting' THEN 0
                 WHEN COALESCE(token_type, type) = 'prebooked' OR upper(token_number) LIKE 'PB%' THEN 1
                 WHEN COALESCE(token_type, type) = 'review' THEN 2 ELSE 3 END,
            expected_sod NULLS FIRST, id) AS position
  FROM tokens WHERE status IN ('waiting', 'consulting'))
SELECT CAST(queue_date AS VARCHAR) AS queue_date, CAST(doctor_id AS BIGINT) AS doctor_id, CAST(position AS BIGINT) AS step,
       CAST(id AS BIGINT) AS token_id, token_number,
       CASE WHEN position = 1 THEN 'completed' ELSE 'consulting' END AS new_status
FROM r WHERE position <= 2
"""

SQL["parse_props"] = ADAPTER + f""",
p AS (SELECT event_id, json_extract_string(props, '$.k') AS k_raw FROM events)
SELECT p.event_id, CAST(ev.d AS VARCHAR) AS queue_date, p.k_raw, p.k_raw IS NOT NULL AS k_present,
       {_intval('p.k_raw')} AS k, {_intval('p.k_raw')} > 0 AS k_valid
FROM p JOIN ev ON ev.event_id = p.event_id
"""

_BODIES = """,
src AS (
  SELECT event_id AS req_id, d, props, COALESCE(value < 10, FALSE) AS small, event_type,
         COALESCE(TRY_CAST(json_extract_string(props, '$.k') AS INT), 0) AS k FROM (
    SELECT e.event_id, CAST(e.ts AS DATE) AS d, e.props, e.value, e.event_type FROM events e)),
kinds AS (
  SELECT *, CASE event_type
    WHEN 'view' THEN CASE WHEN k >= 50 THEN 'lab_verify' WHEN small THEN 'verify' ELSE 'checkin' END
    WHEN 'click' THEN CASE WHEN small THEN 'reschedule' ELSE 'break' END
    WHEN 'error' THEN CASE WHEN small THEN 'lab_cancel' ELSE 'pharmacy_cancel' END
    WHEN 'purchase' THEN CASE WHEN small THEN 'pharmacy_status' ELSE 'opd_status' END
    ELSE 'booking_cancel' END AS kind,
    CASE k % 6 WHEN 0 THEN concat('"booking_id": " pb', k, '"') WHEN 1 THEN concat('"booking_id": ', k)
               WHEN 2 THEN concat('"booking_id": {"id": ', k, '}') ELSE concat('"booking_id": "PB', k, '"') END AS booking,
    CASE k % 6 WHEN 1 THEN concat('"token_id": "', k, 'abc"') WHEN 2 THEN '"token_id": [1, 2]'
               ELSE concat('"token_id": ', k) END AS token
  FROM src),
inside AS (
  SELECT *, CASE
    WHEN kind = 'reschedule' THEN concat(booking, ', ',
      CASE k % 5 WHEN 0 THEN concat('"new_date": "', CAST(d AS VARCHAR), '"') WHEN 1 THEN '"new_date": "2024/02/01"'
                 WHEN 2 THEN '"new_date": 20240201' WHEN 3 THEN '"new_date": "2020-02-01"'
                 ELSE '"new_date": "2024-03-01 "' END,
      CASE k % 3 WHEN 0 THEN ', "new_time": "10:30:00"' WHEN 1 THEN ', "new_time": "9:30"' ELSE '' END)
    WHEN kind = 'break' THEN concat(replace(token, 'token_id', 'doctor_id'), ', "action": "',
      CASE k % 3 WHEN 0 THEN 'start_break' WHEN 1 THEN 'end_break' ELSE 'lunch' END, '"')
    WHEN kind = 'pharmacy_cancel' THEN concat(token, ', ',
      CASE WHEN k % 2 = 0 THEN concat('"token_number": "ph1-0', k, '"') ELSE '"reason": true' END)
    WHEN kind IN ('pharmacy_status', 'opd_status') THEN concat(token, ', ',
      CASE k % 4 WHEN 0 THEN '"status": "waiting"' WHEN 1 THEN '"status": "ready"' WHEN 2 THEN '"status": "completed"'
                 ELSE '"status": null' END)
    ELSE booking END AS inner_part FROM kinds),
sent AS (SELECT req_id, d, kind, CASE WHEN k % 6 = 3 THEN concat('{', inner_part) WHEN k % 10 = 4 THEN props
                                      ELSE concat('{', inner_part, '}') END AS body FROM inside),
read_as AS (SELECT *, CASE WHEN json_valid(body) THEN body ELSE '[]' END AS j FROM sent),
wrong AS (
  SELECT *, CASE WHEN json_type(j) <> 'OBJECT' THEN 'body is not a JSON object' ELSE (
    SELECT min_by(concat(f, ' must be a text or a number'), n) FROM (VALUES
      (1, 'booking_id', ['booking_cancel', 'lab_cancel', 'checkin', 'verify', 'lab_verify', 'reschedule']),
      (2, 'new_date', ['reschedule']), (3, 'new_time', ['reschedule']), (4, 'token_number', ['pharmacy_cancel']),
      (5, 'token_id', ['pharmacy_cancel', 'pharmacy_status', 'opd_status']), (6, 'reason', ['pharmacy_cancel']),
      (7, 'status', ['pharmacy_status', 'opd_status']), (8, 'doctor_id', ['break']), (9, 'action', ['break'])) t(n, f, ks)
    WHERE list_contains(ks, kind) AND json_type(j, concat('$.', f)) IN ('OBJECT', 'ARRAY', 'BOOLEAN')) END AS problem
  FROM read_as),
texts AS (
  SELECT *, json_extract_string(j, '$.booking_id') AS b, json_extract_string(j, '$.new_date') AS nd,
         json_extract_string(j, '$.new_time') AS nt, json_extract_string(j, '$.token_number') AS tn,
         json_extract_string(j, '$.token_id') AS ti, json_extract_string(j, '$.reason') AS rs,
         json_extract_string(j, '$.status') AS st, json_extract_string(j, '$.doctor_id') AS di,
         json_extract_string(j, '$.action') AS ac FROM wrong),
typed AS (
  SELECT req_id, d, kind, body, problem,
    CASE WHEN problem IS NULL AND kind IN ('booking_cancel', 'lab_cancel', 'checkin', 'verify', 'lab_verify', 'reschedule')
         THEN COALESCE(upper(trim(b)), '') END AS booking_id,
    CASE WHEN problem IS NULL AND kind = 'reschedule' THEN COALESCE(trim(nd), '') END AS new_date,
    CASE WHEN problem IS NULL AND kind = 'reschedule' THEN COALESCE(trim(nt), '') END AS new_time,
    CASE WHEN problem IS NULL AND kind = 'pharmacy_cancel' THEN COALESCE(upper(trim(tn)), '') END AS token_number,
    CASE WHEN problem IS NULL AND kind IN ('pharmacy_cancel', 'pharmacy_status', 'opd_status')
         THEN @INT_TI END AS token_id,
    CASE WHEN problem IS NULL AND kind = 'pharmacy_cancel' THEN COALESCE(trim(rs), 'Cancelled by patient') END AS reason,
    CASE WHEN problem IS NULL AND kind IN ('pharmacy_status', 'opd_status') THEN COALESCE(trim(st), '') END AS status,
    CASE WHEN problem IS NULL AND kind = 'break' THEN @INT_DI END AS doctor_id,
    CASE WHEN problem IS NULL AND kind = 'break' THEN COALESCE(ac, '') END AS action
  FROM texts)
""".replace("@INT_TI", _intval("ti")).replace("@INT_DI", _intval("di"))

SQL["request_bodies"] = ADAPTER + _BODIES + """
SELECT CAST(req_id AS BIGINT) AS req_id, kind, problem, booking_id, new_date, new_time, token_number, token_id, reason, status,
       doctor_id, action,
       CASE WHEN problem IS NOT NULL THEN NULL
            WHEN booking_id IN ('', '0') THEN CASE WHEN kind = 'lab_verify' THEN 'Lab Booking ID is required'
                                                   ELSE 'Booking ID is required' END
            WHEN new_date IN ('', '0') THEN 'New appointment date is required'
            WHEN kind = 'reschedule' AND NOT regexp_full_match(new_date, '[0-9]{4}-[0-9]{2}-[0-9]{2}')
              THEN 'Invalid date format. Use YYYY-MM-DD'
            WHEN kind = 'reschedule' AND new_date < CAST(d AS VARCHAR) THEN 'Cannot reschedule to a past date'
            WHEN kind = 'reschedule' AND new_time NOT IN ('', '0') AND NOT regexp_full_match(new_time, '[0-9]{2}:[0-9]{2}:[0-9]{2}')
              THEN 'Invalid time format. Use HH:MM:SS'
            WHEN kind = 'pharmacy_cancel' AND token_number IN ('', '0') AND token_id = 0 THEN 'Token number or ID is required'
            WHEN kind = 'pharmacy_status' AND token_id <= 0 THEN 'Invalid token ID'
            WHEN kind = 'pharmacy_status' AND status NOT IN ('waiting', 'processing', 'completed', 'cancelled')
              THEN 'Invalid status. Must be: waiting, processing, completed, cancelled'
            WHEN kind = 'opd_status' AND (token_id = 0 OR status IN ('', '0')) THEN 'Token ID and status are required'
            WHEN kind = 'opd_status' AND status NOT IN ('waiting', 'consulting', 'completed', 'cancelled') THEN 'Invalid status'
            WHEN kind = 'break' AND doctor_id = 0 THEN 'Doctor ID is required'
            WHEN kind = 'break' AND action NOT IN ('start_break', 'end_break')
              THEN 'Invalid action. Use start_break or end_break' END AS complaint
FROM typed
"""

SQL["body_rejects"] = ADAPTER + _BODIES + """
SELECT CAST(req_id AS BIGINT) AS req_id, kind, body, problem FROM typed WHERE problem IS NOT NULL
"""

SQL["request_rejects"] = ADAPTER + """
SELECT 'opd_status' AS source, CAST(req_id AS BIGINT) AS req_id, new_status AS value,
       'Invalid value for new_status. Must be: waiting, consulting, completed, cancelled' AS reason
FROM status_log WHERE NOT COALESCE(new_status IN ('waiting', 'consulting', 'completed', 'cancelled'), FALSE)
UNION ALL
SELECT 'pharmacy_status', req_id, new_status,
       'Invalid value for new_status. Must be: waiting, processing, completed, cancelled'
FROM pharmacy_status_log WHERE NOT COALESCE(new_status IN ('waiting', 'processing', 'completed', 'cancelled'), FALSE)
UNION ALL
SELECT 'lab_status', req_id, new_status,
       'Invalid value for new_status. Must be: waiting, in_progress, completed, cancelled, no_show'
FROM lab_status_log
WHERE NOT COALESCE(new_status IN ('waiting', 'in_progress', 'completed', 'cancelled', 'no_show'), FALSE)
UNION ALL
SELECT 'doctor_break', req_id, action, 'Invalid value for action. Must be: start_break, end_break'
FROM break_log WHERE NOT COALESCE(action IN ('start_break', 'end_break'), FALSE)
"""

_CHECKS = """,
chk AS (
  SELECT req_id, ts, d, upper(trim(booking_id)) AS booking_id, trim(new_date) AS new_date, trim(new_time) AS new_time,
         CASE WHEN COALESCE(upper(trim(booking_id)), '') = '' THEN 'Booking ID is required'
              WHEN COALESCE(trim(new_date), '') = '' THEN 'New appointment date is required'
              WHEN NOT regexp_matches(trim(new_date), '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')
                THEN 'Invalid date format. Use YYYY-MM-DD'
              WHEN trim(new_date) < CAST(d AS VARCHAR) THEN 'Cannot reschedule to a past date'
              WHEN COALESCE(trim(new_time), '') <> ''
                   AND NOT regexp_matches(trim(new_time), '^[0-9]{2}:[0-9]{2}:[0-9]{2}$')
                THEN 'Invalid time format. Use HH:MM:SS' END AS reason
  FROM reschedule_log)
"""

SQL["booking_checks"] = ADAPTER + _CHECKS + """
SELECT CAST(req_id AS BIGINT) AS req_id, booking_id, new_date, new_time, reason, reason IS NULL AS accepted FROM chk
"""

_SUPP = """,
s AS (SELECT s_suppkey, s_name, s_acctbal, CAST(n_regionkey+1 AS INT) AS department_id
      FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

SQL["upsert_doctors"] = ADAPTER + _SUPP + """,
upd AS (
  SELECT CAST(s_suppkey+1 AS INT) AS id, concat(s_name, ' (updated)') AS name, 1000 AS fees, department_id,
         CAST(NULL AS VARCHAR) AS floor_block, 1 AS seq FROM s
  UNION ALL
  SELECT CAST(s_suppkey+1 AS INT), s_name, 1200, department_id, 'Annex', 2 FROM s WHERE s_acctbal > 5000
  UNION ALL
  SELECT CAST(s_suppkey+1000001 AS INT), concat('New ', s_name), 500, department_id, 'Block N', 1
  FROM s),
lst AS (SELECT id, name, fees FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM upd)
        WHERE rn = 1),
fst AS (SELECT id, department_id, floor_block FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS rn
        FROM upd) WHERE rn = 1)
SELECT CAST(COALESCE(b.id, l.id) AS BIGINT) AS id,
       CASE WHEN l.id IS NOT NULL THEN l.name ELSE b.name END AS name,
       CAST(CASE WHEN l.id IS NOT NULL THEN l.fees ELSE b.fees END AS BIGINT) AS fees,
       CAST(CASE WHEN b.id IS NOT NULL THEN b.department_id ELSE f.department_id END AS BIGINT) AS department_id,
       CASE WHEN b.id IS NOT NULL THEN b.floor_block ELSE f.floor_block END AS floor_block
FROM doctors b FULL JOIN lst l ON l.id = b.id LEFT JOIN fst f ON f.id = COALESCE(b.id, l.id)
"""

SQL["insert_absent"] = ADAPTER + _SUPP + """,
cand AS (SELECT CAST(s_suppkey+1 AS INT) AS id, 'Dup' AS name, department_id FROM s
         UNION ALL
         SELECT CAST(s_suppkey+2000001 AS INT), concat('Staff ', s_name), department_id FROM s)
SELECT CAST(id AS BIGINT) AS id, name, CAST(department_id AS BIGINT) AS department_id, 'base' AS source FROM doctors
UNION ALL
SELECT CAST(c.id AS BIGINT), c.name, CAST(c.department_id AS BIGINT), 'inserted'
FROM cand c WHERE NOT EXISTS (SELECT 1 FROM doctors d WHERE d.id = c.id)
"""

SQL["opd_status_fold"] = ADAPTER + """,
r AS (SELECT s.*, t.department_id FROM status_log s JOIN tokens t ON t.id = s.token_id
      WHERE s.new_status IN ('waiting', 'consulting', 'completed', 'cancelled')),
own AS (SELECT token_id, new_status, ts, req_id FROM (
          SELECT *, row_number() OVER (PARTITION BY token_id ORDER BY ts DESC, req_id DESC) AS rn FROM r) WHERE rn = 1),
lc AS (SELECT department_id, d, ts, req_id FROM (
         SELECT *, row_number() OVER (PARTITION BY department_id, d ORDER BY ts DESC, req_id DESC) AS rn
         FROM r WHERE new_status = 'consulting') WHERE rn = 1),
j AS (SELECT t.id, t.queue_date, t.department_id, t.status AS old_status, COALESCE(o.new_status, t.status) AS eff,
             lc.ts IS NOT NULL AND (o.token_id IS NULL OR lc.ts > o.ts OR (lc.ts = o.ts AND lc.req_id > o.req_id)) AS later
      FROM tokens t LEFT JOIN own o ON o.token_id = t.id
      LEFT JOIN lc ON lc.department_id = t.department_id AND lc.d = t.queue_date),
f AS (SELECT *, CASE WHEN eff = 'consulting' AND later THEN 'completed' ELSE eff END AS new_status FROM j)
SELECT CAST(id AS BIGINT) AS id, CAST(queue_date AS VARCHAR) AS queue_date, CAST(department_id AS BIGINT) AS department_id,
       old_status, new_status, new_status <> old_status AS changed
FROM f
"""

_CANCEL_REQ = """,
r AS (SELECT req_id, ts, d, COALESCE(token_id, 0) AS token_id, upper(trim(token)) AS T,
             COALESCE(upper(trim(booking_id)), upper(trim(token))) AS B,
             COALESCE(trim(reason), 'due to being late') AS reason, COALESCE(notify, TRUE) AS notify
      FROM cancel_log WHERE NOT (upper(trim(token)) = '' AND COALESCE(token_id, 0) = 0))
"""

SQL["cancel_tokens"] = ADAPTER + _CANCEL_REQ + """,
hits AS (
  SELECT r.req_id, r.ts, t.id FROM r JOIN tokens t ON r.token_id > 0 AND t.id = r.token_id
  UNION ALL
  SELECT r.req_id, r.ts, t.id FROM r JOIN tokens t
    ON r.token_id <= 0 AND t.queue_date = r.d
   AND (upper(trim(t.token_number)) = r.T OR upper(trim(t.booking_id)) = r.B)),
tokf AS (SELECT id, req_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, req_id) AS rn FROM hits)
         WHERE rn = 1),
pbk AS (SELECT req_id, ts, B AS k FROM r WHERE starts_with(B, 'PB')
        UNION ALL SELECT req_id, ts, T FROM r WHERE T <> B AND starts_with(T, 'PB')),
bkf AS (SELECT * FROM (
          SELECT p.booking_id, p.appointment_date, p.status, k.req_id,
                 row_number() OVER (PARTITION BY p.booking_id ORDER BY k.ts, k.req_id) AS rn
          FROM pbk k JOIN prebooked_appointments p ON upper(trim(p.booking_id)) = k.k) WHERE rn = 1)
SELECT 'token' AS target, CAST(t.id AS VARCHAR) AS target_key, CAST(t.queue_date AS VARCHAR) AS queue_date,
       t.status AS old_status, CAST(f.req_id AS BIGINT) AS req_id, 'cancelled' AS new_status
FROM tokf f JOIN tokens t ON t.id = f.id
UNION ALL
SELECT 'booking', booking_id, CAST(appointment_date AS VARCHAR), status, CAST(req_id AS BIGINT), 'cancelled' FROM bkf
"""

SQL["cancel_answers"] = ADAPTER + """,
q AS (SELECT req_id, d, COALESCE(token_id, 0) AS token_id, upper(trim(token)) AS T,
             COALESCE(upper(trim(booking_id)), upper(trim(token))) AS B,
             COALESCE(trim(reason), 'due to being late') AS reason, COALESCE(notify, TRUE) AS notify,
             NOT (upper(trim(token)) = '' AND COALESCE(token_id, 0) = 0) AS ok FROM cancel_log),
named AS (
  SELECT q.req_id, count(*) AS n FROM q JOIN tokens t ON t.id = q.token_id WHERE q.token_id > 0 GROUP BY q.req_id
  UNION ALL
  SELECT q.req_id, count(*) FROM q JOIN tokens t ON t.queue_date = q.d
    AND (upper(trim(t.token_number)) = q.T OR COALESCE(upper(trim(t.booking_id)) = q.B, FALSE))
  WHERE q.token_id <= 0 GROUP BY q.req_id),
keys AS (SELECT req_id, B AS k FROM q WHERE starts_with(B, 'PB')
         UNION ALL SELECT req_id, T FROM q WHERE T <> B AND starts_with(T, 'PB')),
booked AS (SELECT k.req_id, count(*) AS n FROM keys k JOIN prebooked_appointments p ON upper(trim(p.booking_id)) = k.k
           GROUP BY k.req_id)
SELECT CAST(q.req_id AS BIGINT) AS req_id, ok AS success,
       CASE WHEN ok THEN 'Token cancelled successfully' ELSE 'Token number or ID is required' END AS message,
       CASE WHEN ok THEN notify END AS notified, CASE WHEN ok THEN reason END AS reason,
       CASE WHEN ok THEN CAST(COALESCE(n.n, 0) AS BIGINT) END AS tokens_named,
       CASE WHEN ok THEN CAST(COALESCE(b.n, 0) AS BIGINT) END AS bookings_named
FROM q LEFT JOIN named n ON n.req_id = q.req_id LEFT JOIN booked b ON b.req_id = q.req_id
"""

SQL["cancel_notifications"] = ADAPTER + _CANCEL_REQ + """
SELECT CAST(req_id AS BIGINT) AS req_id, T AS token_number, B AS booking_id, 'cancelled' AS notification_type,
       'Your token has been cancelled ' || reason || '. Please contact reception.' AS message,
       'pending' AS delivery_status
FROM r WHERE notify
"""

_BOOKING_REQ = """,
r AS (SELECT req_id, ts, CASE WHEN upper(trim({c})) IN ('', '0') OR {c} IS NULL THEN '' ELSE upper(trim({c})) END AS B
      FROM {log}),
f AS (SELECT *, row_number() OVER (PARTITION BY B ORDER BY ts, req_id) AS rn FROM r WHERE B <> '')"""

SQL["cancel_bookings"] = ADAPTER + _BOOKING_REQ.format(c="booking_id", log="booking_cancel_log") + """,
c AS (SELECT r.req_id, r.B, r.B <> '' AS success,
             EXISTS (SELECT 1 FROM f JOIN prebooked_appointments p ON upper(trim(p.booking_id)) = f.B
                     WHERE f.req_id = r.req_id AND f.rn = 1 AND p.status <> 'cancelled') AS changed
      FROM r)
SELECT CAST(req_id AS BIGINT) AS req_id, B AS booking_id, success, changed,
       CASE WHEN NOT success THEN 'Booking ID is required' WHEN changed THEN 'Booking cancelled successfully'
            ELSE 'Booking cancelled' END AS message
FROM c
"""

SQL["cancel_booking_targets"] = ADAPTER + _BOOKING_REQ.format(c="booking_id", log="booking_cancel_log") + """,
hits AS (SELECT f.req_id, f.ts, t.id FROM f JOIN tokens t
           ON upper(trim(t.booking_id)) = f.B OR upper(trim(t.token_number)) = f.B),
tf AS (SELECT id, req_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, req_id) AS rn FROM hits)
       WHERE rn = 1)
SELECT 'booking' AS target, p.booking_id AS target_key, p.status AS old_status, CAST(f.req_id AS BIGINT) AS req_id,
       'cancelled' AS new_status
FROM f JOIN prebooked_appointments p ON upper(trim(p.booking_id)) = f.B WHERE f.rn = 1
UNION ALL
SELECT 'token', CAST(t.id AS VARCHAR), t.status, CAST(tf.req_id AS BIGINT), 'cancelled'
FROM tf JOIN tokens t ON t.id = tf.id
"""

SQL["reschedule_tokens"] = ADAPTER + _CHECKS + f""",
l AS (SELECT c.*, row_number() OVER (PARTITION BY c.booking_id ORDER BY ts DESC, req_id DESC) AS rn
      FROM chk c
      WHERE reason IS NULL AND new_time <> ''
        AND EXISTS (SELECT 1 FROM prebooked_appointments b WHERE upper(trim(b.booking_id)) = c.booking_id))
SELECT CAST(t.id AS BIGINT) AS token_id, l.booking_id, CAST(l.req_id AS BIGINT) AS req_id,
       {_hms('t.expected_sod')} AS old_time, l.new_time
FROM l JOIN tokens t ON upper(trim(t.booking_id)) = l.booking_id WHERE l.rn = 1
"""

SQL["reschedule"] = ADAPTER + _CHECKS + f""",
x AS (SELECT c.*, b.appointment_date AS d0, b.appointment_sod AS t0
      FROM chk c LEFT JOIN prebooked_appointments b ON upper(trim(b.booking_id)) = c.booking_id),
y AS (SELECT *, reason IS NULL AND d0 IS NOT NULL AS ok,
             CASE WHEN reason IS NULL AND d0 IS NOT NULL THEN TRY_CAST(new_date AS DATE) END AS nd,
             CASE WHEN reason IS NULL AND d0 IS NOT NULL AND new_time <> ''
                  THEN CAST(substr(new_time, 1, 2) AS INT) * 3600 + CAST(substr(new_time, 4, 2) AS INT) * 60
                       + CAST(substr(new_time, 7, 2) AS INT) END AS nt
      FROM x),
z AS (SELECT *, COALESCE(last_value(nd IGNORE NULLS) OVER w, d0) AS old_date,
                COALESCE(last_value(nt IGNORE NULLS) OVER w, t0) AS old_sod
      FROM y WINDOW w AS (PARTITION BY booking_id ORDER BY ts, req_id
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, COALESCE(nd, old_date) AS new_d, COALESCE(nt, old_sod) AS new_t,
             (COALESCE(nd, old_date) <> old_date OR COALESCE(nt, old_sod) <> old_sod) AS changed FROM z)
SELECT CAST(req_id AS BIGINT) AS req_id, booking_id, ok AS applied, ok AND changed AS success,
       CASE WHEN reason IS NOT NULL THEN reason WHEN d0 IS NULL THEN 'Booking ID not found'
            WHEN changed THEN 'Appointment rescheduled successfully' ELSE 'No changes made to the appointment' END AS message,
       CASE WHEN ok THEN CAST(old_date AS VARCHAR) END AS old_date,
       CASE WHEN ok THEN {_hms('old_sod')} END AS old_time,
       CASE WHEN ok THEN CAST(new_d AS VARCHAR) END AS new_date,
       CASE WHEN ok THEN {_hms('new_t')} END AS new_time,
       ok AND new_time <> '' AND EXISTS (SELECT 1 FROM tokens t WHERE upper(trim(t.booking_id)) = v.booking_id)
         AS token_time_updated
FROM v
"""

_LAB_HIT = _BOOKING_REQ.format(c="booking_code", log="lab_cancel_log") + """,
hit AS (SELECT f.req_id, f.B, p.booking_status FROM f JOIN prebooked_lab_appointments p
          ON upper(trim(p.booking_code)) = f.B AND p.booking_status IN ('booked', 'checked_in') WHERE f.rn = 1)"""

SQL["cancel_lab"] = ADAPTER + _LAB_HIT + """
SELECT CAST(r.req_id AS BIGINT) AS req_id, r.B AS booking_code, r.req_id IN (SELECT req_id FROM hit) AS success,
       CASE WHEN r.B = '' THEN 'Booking ID is required'
            WHEN r.req_id IN (SELECT req_id FROM hit) THEN 'Lab booking cancelled successfully'
            ELSE 'Booking not found or already cancelled' END AS message
FROM r
"""

SQL["cancel_lab_targets"] = ADAPTER + _LAB_HIT + """
SELECT 'booking' AS target, B AS target_key, booking_status AS old_status, CAST(req_id AS BIGINT) AS req_id,
       'cancelled' AS new_status
FROM hit
UNION ALL
SELECT 'lab_token', CAST(lt.token_id AS VARCHAR), lt.token_status, CAST(hit.req_id AS BIGINT), 'cancelled'
FROM hit JOIN lab_tokens lt ON upper(trim(lt.token_number)) = hit.B
 AND lt.token_status IN ('waiting', 'in_progress')
"""

SQL["cancel_pharmacy"] = ADAPTER + """,
r AS (SELECT req_id, ts, d, COALESCE(token_id, 0) AS token_id, upper(trim(token_number)) AS T,
             COALESCE(trim(reason), 'Cancelled by patient') AS reason FROM pharmacy_cancel_log),
tgt AS (
  SELECT r.req_id, t.id AS target_id FROM r LEFT JOIN pharmacy_tokens t ON t.id = r.token_id WHERE r.token_id > 0
  UNION ALL
  SELECT r.req_id, min(t.id) FROM r LEFT JOIN pharmacy_tokens t
    ON upper(trim(t.token_number)) = r.T AND t.queue_date = r.d
  WHERE r.token_id <= 0 AND r.T <> '' GROUP BY r.req_id),
x AS (SELECT r.*, g.target_id, t.status FROM r LEFT JOIN tgt g ON g.req_id = r.req_id
      LEFT JOIN pharmacy_tokens t ON t.id = g.target_id),
fo AS (SELECT req_id FROM (
         SELECT req_id, row_number() OVER (PARTITION BY target_id ORDER BY ts, req_id) AS rn
         FROM x WHERE status IS NOT NULL AND status NOT IN ('cancelled', 'completed')) WHERE rn = 1),
m AS (SELECT x.*, CASE WHEN T = '' AND token_id = 0 THEN 'Token number or ID is required'
                       WHEN status IS NULL THEN 'Token not found'
                       WHEN status = 'completed' THEN 'Cannot cancel a completed token'
                       WHEN x.req_id IN (SELECT req_id FROM fo) THEN NULL
                       ELSE 'Token is already cancelled' END AS refusal FROM x)
SELECT CAST(req_id AS BIGINT) AS req_id, CAST(target_id AS BIGINT) AS target_id, status AS snapshot_status,
       refusal IS NULL AS accepted, refusal, CASE WHEN refusal IS NULL THEN reason END AS cancellation_reason
FROM m
"""

SQL["pharmacy_status_fold"] = ADAPTER + """,
x AS (SELECT r.req_id, r.ts, r.token_id, trim(r.new_status) AS new_status, t.status AS snap, t.token_number
      FROM pharmacy_status_log r LEFT JOIN pharmacy_tokens t ON t.id = r.token_id),
y AS (SELECT *, CASE WHEN token_id <= 0 THEN 'Invalid token ID'
                     WHEN new_status NOT IN ('waiting', 'processing', 'completed', 'cancelled')
                       THEN 'Invalid status. Must be: waiting, processing, completed, cancelled'
                     WHEN snap IS NULL THEN 'Token not found' END AS reason FROM x)
SELECT CAST(req_id AS BIGINT) AS req_id, CAST(token_id AS BIGINT) AS token_id, token_number,
       CASE WHEN reason IS NULL THEN COALESCE(lag(new_status) OVER (PARTITION BY token_id, reason IS NULL
                                                                    ORDER BY ts, req_id), snap) END AS old_status,
       new_status, reason, reason IS NULL AS accepted
FROM y
"""

SQL["break_state"] = ADAPTER + """,
r AS (SELECT * FROM break_log WHERE action IN ('start_break', 'end_break') AND doctor_id <> 0),
st AS (SELECT doctor_id, d AS break_date, ts, req_id FROM (
         SELECT *, row_number() OVER (PARTITION BY doctor_id, d ORDER BY ts DESC, req_id DESC) AS rn
         FROM r WHERE action = 'start_break') WHERE rn = 1),
en AS (SELECT st.doctor_id, st.break_date, e.ts,
              row_number() OVER (PARTITION BY st.doctor_id, st.break_date ORDER BY e.ts DESC, e.req_id DESC) AS rn
       FROM st JOIN r e ON e.action = 'end_break' AND e.doctor_id = st.doctor_id AND e.d = st.break_date
        AND (e.ts > st.ts OR (e.ts = st.ts AND e.req_id > st.req_id)))
SELECT CAST(st.doctor_id AS BIGINT) AS doctor_id, CAST(st.break_date AS VARCHAR) AS break_date,
       strftime(st.ts, '%Y-%m-%d %H:%M:%S') AS break_start, strftime(en.ts, '%Y-%m-%d %H:%M:%S') AS break_end,
       CASE WHEN en.ts IS NULL THEN 'on_break' ELSE 'available' END AS status, en.ts IS NULL AS is_on_break
FROM st LEFT JOIN en ON en.doctor_id = st.doctor_id AND en.break_date = st.break_date AND en.rn = 1
"""

# Admission: all requests and status changes of a (phone, day) one after the other.
# All events of a day in order, one step each: the tokens held so far (stored ones first) decide the next request.
_ADMISSION = """,
ra AS (SELECT l.*,
              (SELECT dp.id FROM departments dp WHERE upper(rtrim(dp.name)) = upper(rtrim(COALESCE(l.department, ''))))
                AS dep_by_name,
              (SELECT dr.department_id FROM doctors dr WHERE dr.id = l.doctor_id) AS dep_by_doc
       FROM opd_issue_log l),
a AS (SELECT *, COALESCE(dep_by_name, CASE WHEN doctor_id > 0 THEN dep_by_doc END) AS department_id FROM ra),
j AS (SELECT l.*, upper(trim(l.test_code)) AS code, t.test_id, t.fee, t.slot_duration,
             CASE WHEN upper(trim(l.test_code)) = '' OR trim(l.patient_name) = '' OR trim(l.patient_phone) = ''
                       OR COALESCE(l.patient_age, 0) <= 0
                    THEN 'Missing required fields: test_code, patient_name, patient_age, patient_phone'
                  WHEN t.test_id IS NULL THEN 'Invalid test code or test not available' END AS reason
      FROM lab_issue_log l LEFT JOIN lab_tests t ON t.test_code = upper(trim(l.test_code))),
v AS (SELECT r.req_id, r.ts, r.d, r.patient_id, upper(trim(r.booking_id)) AS B, p.booking_id, p.doctor_id,
             p.department_id, p.patient_phone, p.appointment_date, p.appointment_sod, p.status AS snap_status
      FROM checkin_log r JOIN prebooked_appointments p ON upper(trim(p.booking_id)) = upper(trim(r.booking_id))
       AND p.status IN ('booked', 'confirmed') AND p.appointment_date >= r.d
      JOIN doctors dr ON dr.id = p.doctor_id),
ask AS (
  SELECT 'opd' AS kind, req_id, ts, d, patient_id, patient_phone AS phone, department_id IS NOT NULL AS valid, '' AS B FROM a
  UNION ALL SELECT 'lab', req_id, ts, d, patient_id, patient_phone, TRUE, '' FROM j WHERE reason IS NULL
  UNION ALL SELECT 'checkin', req_id, ts, d, patient_id, patient_phone, TRUE, B FROM v),
kept AS (
  SELECT queue_date AS d, list({'lab': 0, 'token': id, 'who': COALESCE(patient_id, -1), 'phone': patient_phone,
                                'status': status} ORDER BY id) AS held FROM tokens GROUP BY queue_date),
kept_lab AS (
  SELECT scheduled_date AS d, list({'lab': 1, 'token': token_id, 'who': COALESCE(patient_id, -1),
                                    'phone': patient_phone, 'status': token_status} ORDER BY token_id) AS held
  FROM lab_tokens GROUP BY scheduled_date),
moves AS (
  SELECT u.ts, u.req_id, 0 AS lab, u.token_id, u.new_status AS status, t.queue_date AS d
  FROM status_log u JOIN tokens t ON t.id = u.token_id
  UNION ALL
  SELECT u.ts, u.req_id, 1, u.token_id, u.new_status, t.scheduled_date
  FROM lab_status_log u JOIN lab_tokens t ON t.token_id = u.token_id
  UNION ALL
  SELECT u.ts, u.req_id, CASE WHEN k.kind = 'lab' THEN 1 ELSE 0 END, u.token_id,
         CASE WHEN k.kind = 'lab' THEN u.lab_status ELSE u.new_status END, k.d
  FROM issued_log u JOIN ask k ON 1000000000000 + k.req_id = u.token_id),
evt AS (
  SELECT d, ts, 0 AS step, req_id, kind, CASE WHEN kind = 'lab' THEN 1 ELSE 0 END AS lab,
         1000000000000 + req_id AS token, COALESCE(patient_id, -1) AS who, COALESCE(phone, '') AS phone, valid,
         'waiting' AS status, B FROM ask
  UNION ALL
  SELECT d, ts, 1, req_id, '', lab, token_id, -1, '', FALSE, status, '' FROM moves),
o AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY ts, step, req_id) AS i FROM evt),
walk AS (
  SELECT q.d, 0 AS i, list_concat(COALESCE(k.held, []), COALESCE(l.held, [])) AS held, [''] AS done,
         CAST(NULL AS STRUCT(lab INTEGER, token BIGINT, who BIGINT, phone VARCHAR, status VARCHAR)) AS blocker,
         '' AS answer, '' AS kind, CAST(NULL AS BIGINT) AS req_id
  FROM (SELECT DISTINCT d FROM o) q LEFT JOIN kept k ON k.d = q.d LEFT JOIN kept_lab l ON l.d = q.d
  UNION ALL
  SELECT d, i,
         CASE WHEN step = 1 THEN list_transform(held, lambda x: CASE WHEN x.lab = e_lab AND x.token = e_token
                THEN {'lab': x.lab, 'token': x.token, 'who': x.who, 'phone': x.phone, 'status': e_status} ELSE x END)
              WHEN answer = 'admitted' THEN list_append(held, {'lab': e_lab, 'token': e_token, 'who': e_who,
                'phone': e_phone, 'status': e_status})
              ELSE held END,
         CASE WHEN answer = 'admitted' AND e_b <> '' THEN list_append(done, e_b) ELSE done END,
         blocker, answer, kind, req_id
  FROM (SELECT *, CASE WHEN step = 1 THEN '' WHEN e_b <> '' AND list_contains(done, e_b) THEN 'taken'
                       WHEN blocker IS NOT NULL THEN 'refused' WHEN valid THEN 'admitted' ELSE 'invalid' END AS answer
        FROM (SELECT w.d, w.i + 1 AS i, w.held, w.done, o.step, o.kind, CAST(o.req_id AS BIGINT) AS req_id, o.valid,
                     CAST(o.lab AS INTEGER) AS e_lab, CAST(o.token AS BIGINT) AS e_token, CAST(o.who AS BIGINT) AS e_who,
                     o.phone AS e_phone, o.status AS e_status, o.B AS e_b,
                     CASE WHEN o.step = 0 THEN list_min(list_filter(w.held, lambda x:
                       (x.status = 'waiting' OR x.status = CASE WHEN x.lab = 0 THEN 'consulting' ELSE 'in_progress' END)
                       AND CASE WHEN o.who >= 0 THEN x.who = o.who ELSE o.phone <> '' AND x.phone = o.phone END)) END
                       AS blocker
              FROM walk w JOIN o ON o.d = w.d AND o.i = w.i + 1))),
answers AS MATERIALIZED (SELECT kind, req_id, answer, blocker FROM walk WHERE kind <> ''),
issued AS (
  SELECT *, row_number() OVER (PARTITION BY lab, grp, d ORDER BY ts, req_id)
            + CASE WHEN lab = 0 THEN (SELECT count(*) FROM tokens t WHERE t.department_id = grp AND t.queue_date = d)
                   ELSE (SELECT count(*) FROM lab_tokens t WHERE t.test_id = grp AND t.scheduled_date = d) END AS seq
  FROM (
    SELECT 0 AS lab, 'opd' AS kind, a.req_id, a.ts, a.d, a.department_id AS grp, @INITIAL AS prefix, '' AS own
    FROM a JOIN answers s ON s.kind = 'opd' AND s.req_id = a.req_id AND s.answer = 'admitted'
    UNION ALL
    SELECT 0, 'checkin', v.req_id, v.ts, v.d, v.department_id, '', v.booking_id
    FROM v JOIN answers s ON s.kind = 'checkin' AND s.req_id = v.req_id AND s.answer = 'admitted'
    UNION ALL
    SELECT 1, 'lab', j.req_id, j.ts, j.d, j.test_id, concat(j.code, '-'), ''
    FROM j JOIN answers s ON s.kind = 'lab' AND s.req_id = j.req_id AND s.answer = 'admitted')),
named AS (
  SELECT *, 1000000000000 + req_id AS token_id,
         CASE WHEN own <> '' THEN own ELSE concat(prefix, printf('%03d', seq)) END AS token_number FROM issued),
numbers AS (
  SELECT lab, token_id, token_number FROM named UNION ALL SELECT 0, id, token_number FROM tokens
  UNION ALL SELECT 1, token_id, token_number FROM lab_tokens),
said AS (
  SELECT s.kind, s.req_id, s.answer,
         concat('You already have an active ',
           CASE WHEN s.kind = 'lab' THEN concat('token (', n.token_number, ')',
                  CASE WHEN k.patient_id IS NOT NULL THEN ' from your account' ELSE '' END, ' in ',
                  CASE WHEN n.lab = 0 THEN 'OPD' ELSE 'Lab' END, '. ',
                  CASE WHEN k.patient_id IS NOT NULL THEN 'Only one token per account is allowed. '
                       ELSE concat('Status: ', upper(s.blocker.status[1]), s.blocker.status[2:], '. ') END)
                ELSE concat(CASE WHEN n.lab = 0 THEN 'OPD consultation' ELSE 'Lab test' END, ' token (', n.token_number,
                  CASE WHEN k.patient_id IS NOT NULL THEN ') from your account. Only one token per account is allowed. '
                       ELSE '). You can only have one token at a time. ' END) END,
           'Please complete, cancel, or wait for it to expire',
           CASE WHEN s.kind = 'checkin' THEN ' before checking in.' ELSE '.' END) AS refusal
  FROM answers s JOIN ask k ON k.kind = s.kind AND k.req_id = s.req_id
  JOIN numbers n ON n.lab = s.blocker.lab AND n.token_id = s.blocker.token
  WHERE s.answer = 'refused')""".replace("@INITIAL", _initial("a.department"))


def _depth_with_stored(lab: int, stored: str, updates: str, active: str) -> str:
    """CTE ``ahead``: active tokens of the group when each issued token arrives; stored ones are there from the start."""
    return f""",
line AS (
  SELECT token_id, grp, d, ts, 0 AS k, token_id AS s, 1 AS act FROM named WHERE lab = {lab}
  UNION ALL SELECT token_id, grp, d, TIMESTAMP '1900-01-01', -1, token_id, CASE WHEN status IN ({active}) THEN 1 ELSE 0 END
  FROM ({stored})
  UNION ALL SELECT u.token_id, t.grp, t.d, u.ts, 1, u.req_id, CASE WHEN u.status IN ({active}) THEN 1 ELSE 0 END
  FROM ({updates}) u JOIN (SELECT token_id, grp, d FROM named WHERE lab = {lab} UNION ALL SELECT token_id, grp, d
                           FROM ({stored})) t ON t.token_id = u.token_id),
steps AS (SELECT *, act - COALESCE(lag(act) OVER (PARTITION BY token_id ORDER BY ts, k, s), 0) AS delta FROM line),
ahead AS (
  SELECT token_id, COALESCE(sum(delta) OVER (PARTITION BY grp, d ORDER BY ts, k, s
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM steps WHERE TRUE QUALIFY k = 0)"""


_RECURSIVE_ADAPTER = ADAPTER.replace("WITH ", "WITH RECURSIVE ", 1)

SQL["issue_opd"] = _RECURSIVE_ADAPTER + _ADMISSION + _depth_with_stored(
    0, "SELECT id AS token_id, department_id AS grp, queue_date AS d, status FROM tokens",
    "SELECT token_id, ts, req_id, new_status AS status FROM status_log "
    "UNION ALL SELECT token_id, ts, req_id, new_status FROM issued_log", "'waiting'") + f"""
SELECT CAST(n.req_id AS BIGINT) AS req_id, TRUE AS accepted, CAST(NULL AS VARCHAR) AS reason,
       CAST(n.token_id AS BIGINT) AS token_id, n.token_number,
       CAST(n.grp AS BIGINT) AS department_id, CAST(n.d AS VARCHAR) AS queue_date,
       CAST(h.ahead AS BIGINT) AS patients_ahead, {_hms(f"(({_sod('n.ts')} + h.ahead * 600) % 86400)")} AS expected_time
FROM named n JOIN ahead h ON h.token_id = n.token_id WHERE n.kind = 'opd'
UNION ALL
SELECT CAST(a.req_id AS BIGINT), FALSE, COALESCE(s.refusal, 'Invalid department'), NULL, NULL, NULL,
       CAST(a.d AS VARCHAR), NULL, NULL
FROM a LEFT JOIN said s ON s.kind = 'opd' AND s.req_id = a.req_id
WHERE a.req_id NOT IN (SELECT req_id FROM named WHERE kind = 'opd')
"""

SQL["issue_lab"] = _RECURSIVE_ADAPTER + _ADMISSION + _depth_with_stored(
    1, "SELECT token_id, test_id AS grp, scheduled_date AS d, token_status AS status FROM lab_tokens",
    "SELECT token_id, ts, req_id, new_status AS status FROM lab_status_log "
    "UNION ALL SELECT token_id, ts, req_id, lab_status FROM issued_log", "'waiting', 'in_progress'") + """
SELECT CAST(n.req_id AS BIGINT) AS req_id, TRUE AS accepted, CAST(NULL AS VARCHAR) AS reason,
       CAST(n.token_id AS BIGINT) AS token_id, n.token_number,
       CAST(n.grp AS BIGINT) AS test_id, CAST(n.d AS VARCHAR) AS queue_date,
       CASE WHEN lower(trim(j.patient_gender)) IN ('male', 'female', 'other') THEN lower(trim(j.patient_gender))
            ELSE 'other' END AS patient_gender,
       CAST(CASE WHEN j.payment_amount <= 0 THEN j.fee ELSE j.payment_amount END AS DOUBLE) AS payment_amount,
       CAST(h.ahead + 1 AS BIGINT) AS queue_position, CAST(h.ahead * j.slot_duration AS BIGINT) AS wait_time
FROM named n JOIN ahead h ON h.token_id = n.token_id JOIN j ON j.req_id = n.req_id WHERE n.kind = 'lab'
UNION ALL
SELECT CAST(j.req_id AS BIGINT), FALSE, COALESCE(j.reason, s.refusal), NULL, NULL, NULL, CAST(j.d AS VARCHAR), NULL,
       NULL, NULL, NULL
FROM j LEFT JOIN said s ON s.kind = 'lab' AND s.req_id = j.req_id
WHERE j.req_id NOT IN (SELECT req_id FROM named WHERE kind = 'lab')
"""

SQL["issue_pharmacy"] = ADAPTER + """,
j AS (SELECT l.*, CASE WHEN COALESCE(l.pharmacy_id, 0) <= 0 THEN 'Invalid pharmacy selected'
                       WHEN COALESCE(trim(l.patient_name), '') = '' THEN 'Patient name is required'
                       WHEN p.id IS NULL THEN 'Selected pharmacy not found or inactive' END AS reason
      FROM pharmacy_issue_log l LEFT JOIN pharmacies p ON p.id = l.pharmacy_id AND p.is_active),
ok AS (SELECT *, req_id + 1 AS token_id, row_number() OVER (PARTITION BY pharmacy_id, d ORDER BY ts, req_id) AS seq
       FROM j WHERE reason IS NULL)""" + _depth("ok", "pharmacy_status_log", "pharmacy_id, d", "'waiting'") + """
SELECT CAST(ok.req_id AS BIGINT) AS req_id, TRUE AS accepted, CAST(NULL AS VARCHAR) AS reason,
       CAST(ok.token_id AS BIGINT) AS token_id,
       concat('PH', CAST(ok.pharmacy_id AS VARCHAR), '-', printf('%03d', ok.seq)) AS token_number,
       CAST(ok.pharmacy_id AS BIGINT) AS pharmacy_id, CAST(ok.d AS VARCHAR) AS queue_date,
       CAST(dp.ahead AS BIGINT) AS patients_ahead, CAST(dp.ahead * 3 AS VARCHAR) || ' mins' AS estimated_wait
FROM ok JOIN dp_ok dp ON dp.token_id = ok.token_id
UNION ALL
SELECT CAST(req_id AS BIGINT), FALSE, reason, NULL, NULL, CAST(pharmacy_id AS BIGINT), CAST(d AS VARCHAR), NULL, NULL
FROM j WHERE reason IS NOT NULL
"""

SQL["checkin_bookings"] = _RECURSIVE_ADAPTER + _ADMISSION + f""",
acc AS (SELECT v.* FROM v JOIN answers s ON s.kind = 'checkin' AND s.req_id = v.req_id AND s.answer = 'admitted'),
counted AS (SELECT acc.*,
        (SELECT count(*) FROM tokens t
          WHERE t.doctor_id = acc.doctor_id AND t.queue_date = acc.d AND t.status IN ('waiting', 'consulting')
            AND (t.token_type = 'prebooked' OR upper(t.token_number) LIKE 'PB%')
            AND COALESCE(t.expected_sod, t.created_sod) < acc.appointment_sod)
      + (SELECT count(*) FROM prebooked_appointments p
          WHERE p.doctor_id = acc.doctor_id AND p.appointment_date = acc.d AND p.status = 'booked'
            AND p.appointment_sod < acc.appointment_sod AND upper(trim(p.booking_id)) <> acc.B)
      + (SELECT count(*) FROM acc c
          WHERE c.doctor_id = acc.doctor_id AND c.d = acc.d
            AND (c.ts < acc.ts OR (c.ts = acc.ts AND c.req_id < acc.req_id))
            AND c.appointment_sod < acc.appointment_sod
            AND NOT (c.snap_status = 'booked' AND c.appointment_date = c.d)) AS ahead
      FROM acc)
SELECT CAST(req_id AS BIGINT) AS req_id, B AS booking_id, TRUE AS accepted, CAST(NULL AS VARCHAR) AS reason,
       booking_id AS token_number, CAST(doctor_id AS BIGINT) AS doctor_id,
       CAST(department_id AS BIGINT) AS department_id, CAST(d AS VARCHAR) AS queue_date,
       {_hms('appointment_sod')} AS expected_time, CAST(ahead AS BIGINT) AS patients_ahead,
       CAST(ahead * 10 AS BIGINT) AS wait_time
FROM counted
UNION ALL
SELECT CAST(r.req_id AS BIGINT), upper(trim(r.booking_id)), FALSE, COALESCE(s.refusal, 'Invalid or expired booking'),
       NULL, NULL, NULL, CAST(r.d AS VARCHAR), NULL, NULL, NULL
FROM checkin_log r LEFT JOIN said s ON s.kind = 'checkin' AND s.req_id = r.req_id
WHERE r.req_id NOT IN (SELECT req_id FROM acc)
"""

SQL["status_alerts"] = ADAPTER + """,
t AS (SELECT id, department_id, queue_date, status AS snap, token_number, doctor_id FROM tokens),
r AS (SELECT s.req_id, s.ts, s.d, s.token_id, s.new_status, t.department_id, t.queue_date, t.snap, t.token_number,
             t.doctor_id
      FROM status_log s JOIN t ON t.id = s.token_id
      WHERE s.new_status IN ('waiting', 'consulting', 'completed', 'cancelled')),
c AS (SELECT department_id, d, ts, req_id FROM r WHERE new_status = 'consulting'),
o AS (SELECT r.*, lag(new_status) OVER w AS pst, lag(ts) OVER w AS pts, lag(req_id) OVER w AS preq
      FROM r WINDOW w AS (PARTITION BY token_id ORDER BY ts, req_id)),
b AS (SELECT o.*, COALESCE(pst, snap) AS prev,
             COALESCE(pst, snap) = 'consulting' AND EXISTS (
               SELECT 1 FROM c WHERE c.department_id = o.department_id AND c.d = o.queue_date
                 AND (o.pts IS NULL OR c.ts > o.pts OR (c.ts = o.pts AND c.req_id > o.preq))
                 AND (c.ts < o.ts OR (c.ts = o.ts AND c.req_id < o.req_id))) AS displaced
      FROM o),
f AS (SELECT b.*, new_status IN ('cancelled', 'consulting')
                  AND new_status <> CASE WHEN displaced THEN 'completed' ELSE prev END AS alert FROM b),
g AS (SELECT f.*, COALESCE(sum(CASE WHEN alert AND new_status = 'cancelled' THEN 1 ELSE 0 END)
                    OVER (PARTITION BY token_id ORDER BY ts, req_id
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb FROM f)
SELECT CAST(g.token_id AS BIGINT) AS token_id, CAST(g.req_id AS BIGINT) AS req_id,
       CAST(g.queue_date AS VARCHAR) AS queue_date, g.new_status AS alert,
       CASE WHEN g.new_status = 'cancelled' THEN '❌ Token Cancelled' ELSE '\U0001f514 Your Turn!' END AS title,
       CASE WHEN g.new_status = 'cancelled'
            THEN 'Your token ' || g.token_number || ' has been cancelled due to being late. Please contact reception.'
            ELSE 'Token ' || g.token_number || ' is now being called. Please proceed to '
                 || COALESCE(dr.name, 'the consultation room') || '.' END AS message
FROM g LEFT JOIN doctors dr ON dr.id = g.doctor_id
WHERE g.alert AND g.cb = 0
"""

SQL["expired_tokens"] = ADAPTER + """,
r AS (SELECT s.*, t.department_id, t.queue_date AS td FROM status_log s JOIN tokens t ON t.id = s.token_id
      WHERE s.new_status IN ('waiting', 'consulting', 'completed', 'cancelled')),
own AS (SELECT token_id, new_status, ts, req_id FROM (
          SELECT *, row_number() OVER (PARTITION BY token_id ORDER BY ts DESC, req_id DESC) AS rn
          FROM r WHERE d <= td) WHERE rn = 1),
lc AS (SELECT department_id, d, ts, req_id FROM (
         SELECT *, row_number() OVER (PARTITION BY department_id, d ORDER BY ts DESC, req_id DESC) AS rn
         FROM r WHERE new_status = 'consulting') WHERE rn = 1),
j AS (SELECT t.id, t.token_number, t.queue_date, t.department_id, t.doctor_id, COALESCE(o.new_status, t.status) AS eff,
             lc.ts IS NOT NULL AND (o.token_id IS NULL OR lc.ts > o.ts OR (lc.ts = o.ts AND lc.req_id > o.req_id)) AS later
      FROM tokens t LEFT JOIN own o ON o.token_id = t.id
      LEFT JOIN lc ON lc.department_id = t.department_id AND lc.d = t.queue_date),
f AS (SELECT *, CASE WHEN eff = 'consulting' AND later THEN 'completed' ELSE eff END AS st FROM j)
SELECT CAST(id AS BIGINT) AS id, token_number, CAST(queue_date AS VARCHAR) AS queue_date,
       CAST(department_id AS BIGINT) AS department_id, CAST(doctor_id AS BIGINT) AS doctor_id,
       st AS status_at_close, strftime(queue_date + 1, '%Y-%m-%d') || ' 00:00:00' AS expired_at
FROM f WHERE st IN ('waiting', 'consulting')
"""

SQL["staff_roster"] = ADAPTER + """
SELECT CAST(s.id AS BIGINT) AS id, s.name, s.email, s.role, CAST(s.dept_id AS BIGINT) AS dept_id,
       CAST(s.doc_id AS BIGINT) AS doc_id, d.name AS department_name
FROM staff s LEFT JOIN departments d ON s.dept_id = d.id
"""

SQL["pharmacy_roster"] = ADAPTER + """
SELECT CAST(ps.id AS BIGINT) AS id, ps.staff_id, ps.name, CAST(ps.pharmacy_id AS BIGINT) AS pharmacy_id,
       p.name AS pharmacy_name, p.block, p.floor, p.wing
FROM pharmacy_staff ps JOIN pharmacies p ON ps.pharmacy_id = p.id
"""

SQL["harmonize_bookings"] = ADAPTER + """
SELECT booking_id AS code, patient_name, CAST(appointment_date AS VARCHAR) AS appointment_date,
       CAST(appointment_sod AS BIGINT) AS appointment_sod, status, CAST(department_id AS BIGINT) AS department_id,
       CAST(0 AS BIGINT) AS test_id, 'opd' AS kind
FROM prebooked_appointments
UNION ALL
SELECT booking_code, patient_name, CAST(appointment_date AS VARCHAR), CAST(appointment_sod AS BIGINT), booking_status,
       CAST(0 AS BIGINT), CAST(test_id AS BIGINT), 'lab'
FROM prebooked_lab_appointments
"""

SQL["backfill_locations"] = ADAPTER + """
SELECT CAST(d.id AS BIGINT) AS id, CAST(d.department_id AS BIGINT) AS department_id,
       COALESCE(upper(v.name), d.wing) AS wing
FROM doctors d LEFT JOIN departments v ON v.id = d.department_id AND v.id % 2 = 0
"""

SQL["reset_bookings"] = ADAPTER + """
SELECT CAST(id AS BIGINT) AS id, booking_id, CAST(appointment_date AS VARCHAR) AS appointment_date,
       CASE WHEN appointment_date = (SELECT max(appointment_date) FROM prebooked_appointments) THEN 'booked'
            ELSE status END AS status
FROM prebooked_appointments
"""

SQL["wipe_day"] = ADAPTER + """
SELECT CAST(id AS BIGINT) AS id, token_number, status, CAST(queue_date AS VARCHAR) AS queue_date
FROM tokens WHERE queue_date <> (SELECT min(queue_date) FROM tokens)
"""

SQL["public_queue"] = ADAPTER + _LIVE_ROWS + f""",
pos AS (SELECT *, row_number() OVER (PARTITION BY queue_date, doctor_id {_LIVE_ORDER}) AS position FROM lq_rows)""" + """
SELECT concat('{"queue_date":"', CAST(queue_date AS VARCHAR), '","doctor_id":', CAST(doctor_id AS VARCHAR),
              ',"position":', CAST(position AS VARCHAR), ',"token_number":"', token_number, '","status":"', status,
              '"}') AS response
FROM pos
"""
