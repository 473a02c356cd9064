"""DuckDB SQL for the catalogue."""

from __future__ import annotations

_TEAMS = "teams as (select c_custkey team_id, c_name name, c_mktsegment owner, cast(round(c_acctbal * 100) as bigint) initial_purse from customer)"
_TX = """tx as (select o_orderkey sequence, o_orderdate ts, case when o_orderstatus = 'O' then 'unsold' else 'sale' end "type", o_orderstatus = 'P' reversed,
 case when o_orderstatus <> 'O' then o_custkey end team_id, case when o_orderstatus <> 'O' then cast(round(o_totalprice) as bigint) end price, o_orderpriority note from orders)"""
_FIN = f"""{_TEAMS}, {_TX}, spent as (select team_id t, cast(sum(price) as bigint) s, count(*) n from tx where "type" = 'sale' and not reversed group by 1),
 fin as (select team_id, name, initial_purse, coalesce(s, 0) spent, initial_purse - coalesce(s, 0) remaining, coalesce(n, 0) purchased from teams left join spent on t = team_id)"""
_PLAYERS = "players as (select p_partkey player_id, p_name name, p_type role, p_brand category, cast(round(p_retailprice * 100) as bigint) base_price from part)"
_LINES = """lines as (select l_orderkey lot, l_linenumber line, l_suppkey team_id, l_partkey player_id, case l_returnflag when 'N' then 'sold' when 'R' then 'unsold' else 'available' end status,
 l_quantity quantity, cast(round(l_extendedprice * 100) as bigint) price, l_shipdate ts from lineitem)"""
_FRAN = "fran as (select s_suppkey team_id, s_name name, cast(round(s_acctbal * 100) as bigint) initial_purse from supplier)"
_ACT = "act as (select event_id, ts, user_id actor, event_type action, cast(round(value * 100) as bigint) amount from events)"
_ROLES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
_UNDO = """led as (select 't' || sequence tx_id, 2 * sequence pos, "type", team_id, price, null::varchar reference_id from tx
 union all select 'u' || sequence, 2 * sequence + 1, 'undo', team_id, price, 't' || case when sequence % 7 = 0 then sequence + 1 when sequence % 11 = 0 then -1 else sequence end from tx where reversed)"""


def _cell(c: str) -> str:
    t = f"coalesce(cast({c} as varchar), '')"
    return f"""'"' || replace(case when regexp_matches({t}, '^\\s*[=+@-]') then '''' || {t} else {t} end, '"', '""') || '"'"""


def _money(c: str) -> str:
    """Groups of two above the last three digits, without look-ahead."""
    a = f"cast(abs({c}) as varchar)"
    head = f"reverse(regexp_replace(reverse(left({a}, length({a}) - 3)), '(..)', '\\1,', 'g'))"
    return f"case when {c} is null then '—' else case when {c} < 0 then '-' else '' end || case when length({a}) > 3 then ltrim({head}, ',') || ',' || right({a}, 3) else {a} end end"


_POOL = f"""{_PLAYERS}, {_LINES}, latest as (select *, row_number() over (partition by player_id order by ts desc, lot desc, line desc, team_id desc, price desc, quantity desc) r from lines),
 pool as (select p.*, coalesce(status, 'available') status, case when status = 'sold' then team_id end team_id, case when status = 'sold' then price end price, case when status in ('sold', 'unsold') then lot end sequence from players p left join (select * from latest where r = 1) l using (player_id))"""
_MONEY = "money as (select f.team_id, f.name, initial_purse, coalesce(s, 0) spent, initial_purse - coalesce(s, 0) remaining, coalesce(n, 0) purchased from fran f left join (select team_id, cast(sum(price) as bigint) s, count(*) n from pool where status = 'sold' group by 1) x on x.team_id = f.team_id)"


def _line(*cells: str) -> str:
    return "concat_ws(',', " + ", ".join(_cell(c) for c in cells) + ")"


def _fold() -> str:
    """The command log of each actor, one command a recursion step, over the whole state: statuses and latest results of twenty players, money of three teams."""
    first = "coalesce(bid + 50, 100)"
    why = f"""case cmd when 'player.select' then case when cur is not null then 'a player is current' when st[p] not in ('available', 'unsold') then 'not eligible' end
 when 'bid' then case when cur is null then 'no current player' when coalesce(a, 0) < 1 then 'bad amount' when a < {first} or (a - {first}) % 50 <> 0 then 'breaks the increment rule' when a <= bid then 'not above the highest bid' when a > rem[t] then 'beyond the purse' end
 when 'sell' then case when cur is null then 'no current player' when bid is null then 'no bid' when bid > rem[bt] then 'beyond the purse' end
 when 'unsold' then case when cur is null then 'no current player' when bid is not null then 'has a bid' end
 else case when last <> 'sale' then 'nothing to undo' when cur is not null and bid is not null then 'the current player has a bid' end end"""
    put = lambda list_, at, value: f"list_transform({list_}, lambda x, i: case when i = {at} then {value} else x end)"
    return f"""
with recursive {_ACT}, log as (select actor, event_id + 100 seq, case action when 'view' then 'player.select' when 'click' then 'bid' when 'purchase' then 'sell' when 'signup' then 'unsold' else 'undo' end cmd,
 event_id % 20 + 1 p, case when action = 'click' then event_id % 3 + 1 end t, case when action = 'click' then amount - amount % 50 end a, row_number() over (partition by actor order by event_id) rn from act),
 s as (select actor, 0::bigint rn, list_transform(range(20), lambda x: 'available') st, list_transform(range(20), lambda x: '') res, [50000::bigint, 50000, 50000] rem, null::bigint cur, null::bigint bid, null::bigint bt, 0::bigint sq, '' last, null::bigint lp, null::bigint lt, null::bigint lprice,
 0::bigint seq, '' cmd, null::varchar reason, null::bigint tx, null::bigint who, null::bigint team, null::bigint price, null::bigint remaining from (select distinct actor from act)
 union all
 select actor, rn,
 case when reason is not null then st when cmd = 'player.select' then {put("st", "p", "'current'")} when cmd = 'sell' then {put("st", "cur", "'sold'")} when cmd = 'unsold' then {put("st", "cur", "'unsold'")}
  when cmd = 'undo' then list_transform(st, lambda x, i: case when i = lp then 'current' when i = cur then case when res[i] = 'unsold' then 'unsold' else 'available' end else x end) else st end,
 case when reason is not null then res when cmd = 'sell' then {put("res", "cur", "'sale'")} when cmd = 'unsold' then {put("res", "cur", "'unsold'")} when cmd = 'undo' then {put("res", "lp", "'undo'")} else res end,
 case when reason is not null then rem when cmd = 'sell' then {put("rem", "bt", "x - bid")} when cmd = 'undo' then {put("rem", "lt", "x + lprice")} else rem end,
 case when reason is not null then cur when cmd = 'player.select' then p when cmd in ('sell', 'unsold') then null when cmd = 'undo' then lp else cur end,
 case when reason is not null then bid when cmd = 'bid' then a when cmd = 'undo' then lprice else case when cmd in ('player.select', 'sell', 'unsold') then null else bid end end,
 case when reason is not null then bt when cmd = 'bid' then t when cmd = 'undo' then lt else case when cmd in ('player.select', 'sell', 'unsold') then null else bt end end,
 case when reason is null and cmd in ('sell', 'unsold', 'undo') then sq + 1 else sq end,
 case when reason is not null then last when cmd = 'sell' then 'sale' when cmd = 'unsold' then 'unsold' when cmd = 'undo' then 'undo' else last end,
 case when reason is null and cmd = 'sell' then cur else lp end, case when reason is null and cmd = 'sell' then bt else lt end, case when reason is null and cmd = 'sell' then bid else lprice end,
 seq, cmd, reason, case when reason is null and cmd in ('sell', 'unsold', 'undo') then sq + 1 end,
 case when reason is not null or cmd = 'player.select' then p when cmd = 'undo' then lp else cur end,
 case when reason is not null or cmd = 'bid' then t when cmd = 'sell' then bt when cmd = 'undo' then lt end,
 case when reason is not null or cmd = 'bid' then a when cmd = 'sell' then bid when cmd = 'undo' then lprice end,
 case when reason is not null or cmd = 'bid' then rem[t] when cmd = 'sell' then rem[bt] - bid when cmd = 'undo' then rem[lt] + lprice end
 from (select s.* exclude (rn, seq, cmd, reason, tx, who, team, price, remaining), log.rn, log.seq, log.cmd, log.p, log.t, log.a, {why.replace("case cmd", "case log.cmd", 1)} reason from s join log on log.actor = s.actor and log.rn = s.rn + 1))
select actor event_id, seq, cmd command, reason is null accepted, reason, tx tx_sequence, 'p' || (who - 1) player_id, 't' || (team - 1) team_id, price, remaining from s where rn > 0
union all select actor, i, 'team.add', true, null, null, null, 't' || i, null, 50000 from (select distinct actor from act), range(3) r(i)
union all select actor, 3 + i, 'player.add', true, null, null, 'p' || i, null, null, null from (select distinct actor from act), range(20) r(i)
union all select distinct actor, 50, 'start', true, null, null, null, null, null, null from act
"""


ORACLES = {
    "team_finance": f"with {_FIN} select * from fin",
    "total_and_average_sale": f"""with {_TX} select count(*) sales, cast(coalesce(sum(price), 0) as bigint) total_spend, case when count(*) = 0 then 0 else cast(floor(sum(price) / count(*) + 0.5) as bigint) end average_price from tx where "type" = 'sale' and not reversed""",
    "status_counts": f"""with {_TX} select count(*) filter ("type" = 'sale' and not reversed) sold, count(*) filter ("type" = 'sale' and reversed) reversed, count(*) filter ("type" = 'unsold') unsold, count(distinct team_id) active_teams, coalesce(max(sequence), 0) max_sequence from tx""",
    "top_priced_with_tiebreak": f"with {_PLAYERS} select role, player_id, name, base_price from (select *, row_number() over (partition by role order by base_price desc, player_id) r from players) where r = 1",
    "role_counts_pivot": f"with {_PLAYERS}, {_LINES} select team_id, " + ", ".join(f"count(*) filter (role = '{r}') \"{r}\"" for r in _ROLES) + " from lines join players using (player_id) where status = 'sold' group by team_id",
    "role_composition": f"""with {_PLAYERS}, {_LINES}, {_FRAN}, rules(role, mn, mx) as (values ('ECONOMY', 1, 40), ('LARGE', 2, 50), ('MEDIUM', 0, null), ('PROMO', 3, 0), ('SMALL', 0, 45), ('STANDARD', 5, 60)),
 have as (select team_id, role, count(*) n from lines join players using (player_id) where status = 'sold' group by 1, 2),
 g as (select fran.team_id, rules.role, mn, mx, coalesce(n, 0) c from fran cross join rules left join have on have.team_id = fran.team_id and have.role = rules.role),
 k as (select *, cast(coalesce(nullif(mx, 0), greatest(mn, c, 1)) as bigint) cap from g)
 select team_id, role, c "count", cap, cast(least(100, floor(c * 100 / cap + 0.5)) as bigint) pct, (mx is null or c <= mx) and c >= mn ok from k""",
    "squad_listing": f"with {_PLAYERS}, {_LINES}, {_FRAN} select l.team_id, f.name team_name, lot, line, l.player_id, p.name player_name, role, price from lines l join players p using (player_id) join fran f on f.team_id = l.team_id where status = 'sold' and role = 'PROMO' and contains(lower(p.name || ' ' || role), 'bolt')",
    "eligible_players": f"with {_LINES} select lot, line, player_id, status from lines where status in ('available', 'unsold')",
    "search_players": f"with {_PLAYERS} select * from players where contains(lower(concat_ws(' ', player_id, name, role, category)), 'red w') and role = 'SMALL'",
    "search_players_category": f"with {_PLAYERS} select player_id, name, role from players where category = 'Brand#11'",
    "search_teams": f"with {_TEAMS} select team_id, name, owner from teams where contains(lower(concat_ws(' ', name, team_id, owner)), 'build')",
    "other_active_teams": f"with {_TEAMS} select team_id, name from teams where initial_purse > 0 and team_id <> 7",
    "distinct_categories": f"with {_PLAYERS} select distinct category from players where category <> ''",
    "player_queue": f"with {_PLAYERS}, q as (select player_id, name, row_number() over (order by player_id) rank from players where role = 'LARGE') select player_id, name, rank, case when rank < 100 then lpad(cast(rank as varchar), 3, '0') else cast(rank as varchar) end label from q",
    "recent_sales_all": f"""with {_TX} select sequence, team_id, price, reversed from tx where "type" = 'sale' order by ts desc, sequence desc limit 6""",
    "recent_sales_active": f"""with {_TX} select sequence, team_id, price from tx where "type" = 'sale' and not reversed order by ts desc, sequence desc limit 8""",
    "history_labelled": f"""with {_TEAMS}, {_TX} select sequence, case when "type" = 'sale' and reversed then 'Reversed sale' when "type" = 'sale' then 'Sold' else 'Unsold' end label, coalesce(name, '—') team_name, price from tx left join teams using (team_id)""",
    "last_event_can_undo": f"with {_ACT} select actor, event_id last_event, action last_action, action = 'purchase' can_undo from (select *, row_number() over (partition by actor order by ts desc, event_id desc) r from act) where r = 1",
    "last_result_per_player": f"with {_LINES} select player_id, lot, line, status from (select *, row_number() over (partition by player_id order by ts desc, lot desc, line desc, team_id desc, price desc, quantity desc) r from lines) where r = 1",
    "bid_increment_tier": f"with {_TX} select sequence, price, cast(case when price <= 100000 then 5000 when price <= 200000 then 10000 when price <= 300000 then 25000 else 50000 end as bigint) increment from tx where price is not null",
    "next_min_bid_valid": f"""with {_ACT}, b as (select *, max(amount) over (partition by actor order by ts, event_id rows between unbounded preceding and 1 preceding) highest from act where action = 'click'),
 m as (select *, cast(coalesce(highest + 50, 100) as bigint) minimum from b)
 select event_id, actor, amount, highest, minimum, highest is null or amount > highest beats_highest, amount >= minimum and (amount - minimum) % 50 = 0 and (highest is null or amount > highest) valid from m""",
    "running_purse_feasible": f"""with {_TEAMS}, {_TX}, s as (select *, cast(coalesce(sum(price) over (partition by team_id order by ts, sequence rows between unbounded preceding and 1 preceding), 0) as bigint) before from tx where "type" = 'sale' and not reversed)
 select sequence, team_id, price, initial_purse - before remaining_before, price <= initial_purse - before feasible from s join teams using (team_id)""",
    "final_report_rows": f"""with {_PLAYERS}, {_LINES}, {_FRAN}, m as (select f.team_id, coalesce(s, 0) spent, initial_purse - coalesce(s, 0) remaining from fran f left join (select team_id, cast(sum(price) as bigint) s from lines where status = 'sold' group by 1) x on x.team_id = f.team_id)
 select 'SOLD' result, l.team_id, player_id, price, spent, remaining from lines l join players using (player_id) join m on m.team_id = l.team_id where status = 'sold'
 union all select 'UNSOLD', null, player_id, null, null, null from lines where status = 'unsold'""",
    "report_csv_lines": f"with {_FIN} select concat_ws(',', {', '.join(_cell(c) for c in ('team_id', 'name', 'initial_purse', 'spent', 'remaining'))}) line from fin",
    "transactions_csv_lines": f"with {_TX} select concat_ws(',', {', '.join(_cell(c) for c in ('sequence', '\"type\"', 'team_id', 'price', 'note'))}) line from tx",
    "spend_reconciliation": f"""with {_TX}, a as (select team_id, cast(sum(price) as bigint) s from tx where "type" = 'sale' and not reversed group by 1), b as (select team_id, cast(sum(price) as bigint) s from tx where "type" = 'sale' group by 1)
 select team_id, coalesce(a.s, 0) spend_a, coalesce(b.s, 0) spend_b, coalesce(a.s, 0) - coalesce(b.s, 0) difference from a full join b using (team_id) where coalesce(a.s, 0) <> coalesce(b.s, 0)""",
    "squad_slots": f"with {_FIN} select team_id, purchased, cast(greatest(0, 6 - purchased) as bigint) slots_left, cast(greatest(0, 6 - purchased) as varchar) slots_text, cast(3 - purchased as bigint) shortfall from fin",
    "violations_fk": f"with {_TEAMS}, {_TX} select 'fk' check_id, 'transaction' entity, cast(sequence as varchar) \"key\", cast(team_id as varchar) detail from tx where team_id is not null and team_id not in (select team_id from teams where owner <> 'MACHINERY')",
    "violations_overspent": f"with {_FIN} select 'overspent' check_id, 'team' entity, cast(team_id as varchar) \"key\", cast(remaining as varchar) detail from fin where remaining < 0",
    "violations_duplicates": f"""with {_LINES} select 'duplicate' check_id, 'active_sale' entity, cast(player_id as varchar) "key", cast(count(*) as varchar) detail from lines where status = 'sold' group by player_id having count(*) > 1
 union all select 'duplicate', 'line', lot || '/' || line, cast(count(*) as varchar) from lines group by lot, line having count(*) > 1""",
    "violations_tiers": f"""with {_PLAYERS}, t as (select category || '/' || (player_id // 500) set_id, player_id tier_no, case when player_id % 11 <> 0 then player_id // 3 * 100 - player_id % 7 * 150 end up_to, player_id % 13 increment from players),
 x as (select *, (select count(*) from t o where o.set_id = t.set_id and o.tier_no < t.tier_no and o.up_to >= t.up_to) above, (select count(*) from t o where o.set_id = t.set_id and o.tier_no > t.tier_no) behind from t)
 select 'tiers' check_id, 'settings' entity, set_id || '/' || tier_no "key", coalesce(cast(up_to as varchar), 'open') detail from x where above > 0 or up_to < 0 or increment = 0
 union all select 'entered tiers', 'settings', set_id || '/' || tier_no, coalesce(cast(up_to as varchar), 'open') from x where above > 0 or up_to < 0 or increment = 0 or (up_to is null and behind > 0)""",
    "violations_transaction_fields": f"""with {_TX}, {_UNDO}, x as (select tx_id, pos, "type" t, case when pos % 37 = 0 then 'loan' else "type" end kind, case when pos % 41 <> 0 then price end price, case when pos % 43 = 0 and "type" = 'unsold' then 1 else team_id end team_id, pos % 47 = 0 unflagged, case when pos % 3 <> 0 then reference_id end ref from led)
 select 'transaction_fields' check_id, 'transaction' entity, tx_id "key", case when kind = 'loan' then 'type' when pos % 31 = 0 then 'sequence' else kind end detail from x
 where kind = 'loan' or pos % 31 = 0 or (kind = 'sale' and (team_id is null or price is null or price <= 0 or unflagged)) or (kind = 'unsold' and team_id is not null) or (kind = 'undo' and ref is null)""",
    "undo_reference_check": f"""with {_TX}, {_UNDO} select 'undo_reference' check_id, 'transaction' entity, u.tx_id "key", coalesce(u.reference_id, 'none') detail from led u left join led t on u.reference_id = t.tx_id where u."type" = 'undo' and (t.pos is null or t.pos >= u.pos)""",
    "active_sales_from_events": f"""with {_TX}, {_UNDO} select team_id, count(*) sales, cast(sum(price) as bigint) spend from led s where "type" = 'sale' and not exists (select 1 from led u where u."type" = 'undo' and u.reference_id = s.tx_id) group by 1""",
    "retention_top_n": f"with {_ACT} select * from (select actor, event_id, row_number() over (partition by actor order by ts desc, event_id desc) age_rank from act) where age_rank <= 40",
    "clean_text_initials": f"""with {_PLAYERS} select player_id, trim(name) clean, upper(case when contains(name, ' ') then name[1] || split_part(name, ' ', -1)[1] else name[1:3] end) initials, '&lt;' || name || '&amp;&#39;&quot;&gt;' escaped from players""",
    "parse_integer": f"""with {_PLAYERS}, r as (select player_id k, player_id % 16 w, cast(player_id as varchar) t from players),
 v as (select *, case w when 0 then t when 1 then chr(32) || chr(9) || t || ' ' when 2 then t || ',000' when 3 then '+' || t when 4 then '-' || t when 5 then t || 'e3' when 6 then t || '.0' when 7 then t || '.5' when 8 then '0x' || lower(hex(k)) when 9 then '0b' || bin(k)
 when 10 then '0X' || hex(k) when 11 then '.' || t when 12 then t || '.' when 13 then '' when 14 then 'x' || t else '900719925474' || lpad(t, 8, '0') end raw,
 case when w in (0, 1, 3, 6, 8, 9, 10, 12) then k when w = 5 then 1000 * k when w = 13 then 0 end n from r)
 select k, raw, cast(n as bigint) number, cast(case when w = 2 then 1000 * k else n end as bigint) amount from v""",
    "money_grouping": f"with {_FIN} select team_id, {_money('remaining')} money, case when purchased < 100 then lpad(cast(purchased as varchar), 3, '0') else cast(purchased as varchar) end padded from fin",
    "role_alias": f"""with {_PLAYERS} select player_id, raw, case when n in (0, 7, 11) then 'Batter' when n in (1, 8) then 'Wicketkeeper' when n = 2 then 'Bowler' when n in (3, 9, 10) then 'All-rounder' end role
 from (select player_id, player_id % 12 n, list_extract(['Batsman', ' keeper ', 'BOWLER', 'all rounder', 'Umpire', '', 'Wicket-Keeper', 'batswoman', 'Wicket Keeper', 'All-Rounder', 'allrounder', chr(9) || 'Batter'], player_id % 12 + 1) raw from players)""",
    "masked_view": f"with {_FIN} select team_id, name, case when team_id = 7 then purchased end purchased, case when team_id = 7 then initial_purse end initial_purse, case when team_id = 7 then spent end spent, case when team_id = 7 then remaining end remaining, true pin_required from fin",
    "session_validity": f"with {_ACT}, s as (select *, max(case when action = 'signup' then ts end) over (partition by actor order by ts, event_id rows between unbounded preceding and current row) l from act) select event_id, actor, coalesce(ts < l + interval 12 hours, false) valid from s",
    "rate_limit_blocks": f"""with recursive {_ACT}, e as (select cast(actor as varchar) "key", epoch_ms(ts) tm, event_id seq, action = 'signup' ok, row_number() over (partition by actor order by epoch_ms(ts), event_id) rn from act where action in ('error', 'signup')),
 w as (select "key", 0::bigint rn, 0::bigint seq, 0::bigint n, 0::bigint st, 0::bigint un, '' verdict from (select distinct "key" from e)
 union all select e."key", e.rn, e.seq,
 case when un > tm then n when ok then 0 when n = 0 or tm - st > 432000000 then 1 else n + 1 end,
 case when un > tm then st when ok then 0 when n = 0 or tm - st > 432000000 then tm else st end,
 case when un > tm then un when ok then 0 when (case when n = 0 or tm - st > 432000000 then 1 else n + 1 end) >= 5 then tm + 86400000 when n = 0 or tm - st > 432000000 then 0 else un end,
 case when un > tm then 'rejected' when ok then 'ok' when (case when n = 0 or tm - st > 432000000 then 1 else n + 1 end) >= 5 then 'blocked' else 'failed' end
 from w join e on e."key" = w."key" and e.rn = w.rn + 1)
 select "key", seq, verdict, n failures from w where rn > 0""",
    "presence_intervals": f"""with {_ACT}, m as (select *, lead(event_id) over (partition by actor order by ts, event_id) until_event, lead(ts) over (partition by actor order by ts, event_id) nx from act where action in ('signup', 'error'))
 select event_id, actor, until_event, epoch_us(nx) - epoch_us(ts) micros from m where action = 'signup'""",
    "latest_version_wins": f"with {_ACT} select actor, event_id version, action, amount from (select *, row_number() over (partition by actor order by event_id desc) r from act) where r = 1",
    "snapshot_summary": f"""with {_TEAMS}, {_TX} select owner, count(distinct teams.team_id) teams, count(sequence) active_sales from teams left join (select * from tx where "type" = 'sale' and not reversed) x using (team_id) group by 1""",
    "device_labels": f"with {_TEAMS}, {_ACT} select event_id, actor, case when actor % 10 = 0 then 'Admin' when name is not null then 'Team: ' || name else 'Display' end label from act left join teams on actor * 11 = team_id where action = 'view'",
    "full_state_json": f"""with {_TEAMS} select '{{"team_id":' || team_id || ',"name":"' || name || '","owner":"' || owner || '","initial_purse":' || initial_purse || '}}' json from teams""",
    "status_labels": f"""with {_ACT}, s as (select *, case action when 'click' then 'live' when 'view' then 'current' when 'purchase' then 'sold' when 'error' then '' else 'Odd One!' end st from act)
 select event_id, case st when 'live' then 'Live' when 'current' then 'On the block' when 'sold' then 'Sold' when '' then 'Unknown' else st end "text", case st when '' then 'not-started' when 'Odd One!' then 'odd-one-' else st end css,
 case when event_id % 5 = 0 then 'Auction paused by the operator' when st = 'sold' then 'Player sold' when st = 'live' then 'Live bidding' else 'Next player coming up' end headline, '₹' || {_money('amount')} money from s""",
    "display_times": f"with {_ACT} select event_id, strftime(ts, '%d %b, ') || lower(strftime(ts, '%I:%M %p')) shown, lower(strftime(ts, '%I:%M:%S %p')) clock from act",
    "bid_attribution": f"with {_ACT}, s as (select *, last_value(case when action = 'view' then event_id end ignore nulls) over (partition by actor order by ts, event_id rows between unbounded preceding and current row) selected from act) select event_id, actor, amount, selected from s where action = 'click'",
    "spend_rollup": f"""with {_TEAMS}, {_TX} select owner, reversed, cast(sum(price) as bigint) spend, count(*) sales from tx join teams using (team_id) where "type" = 'sale' group by rollup (owner, reversed)""",
    "player_table": f"with {_POOL} select player_id, name, role, base_price, status from pool where status in ('available', 'unsold')",
    "player_table_filtered": f"with {_POOL} select player_id, name, role, status, team_id, price from pool where status = 'sold' and role = 'SMALL' and contains(lower(concat_ws(' ', player_id, name, role, category)), 'red')",
    "squad_table": f"with {_POOL} select player_id, name, role, price, sequence from pool where status = 'sold' and team_id = 7",
    "first_eligible": f"with {_POOL} select player_id, name, status from pool where status <> 'sold' order by player_id limit 1",
    "player_team_labels": f"with {_POOL}, {_FRAN} select player_id, status, case when pool.team_id is null then '—' else coalesce(f.name, 'Team') end team_name from pool left join (select * from fran where team_id % 9 <> 0) f on f.team_id = pool.team_id",
    "players_csv": f"with {_POOL} select {_line('player_id', 'name', 'role', 'base_price', 'null', 'null', 'null', 'category', 'status', 'team_id', 'price', 'sequence')} line from pool",
    "teams_csv": f"with {_FIN} select {_line('f.team_id', 'f.name', 'owner', 'f.initial_purse', 'f.initial_purse > 0', 'null', 'spent', 'remaining', 'purchased')} line from fin f join teams t on t.team_id = f.team_id",
    "transactions_csv": f"""with {_TEAMS}, {_TX}, {_PLAYERS}, {_LINES}, who as (select lot, min(player_id) player_id from lines group by 1)
 select {_line('x.sequence', 'x."type"', 'w.player_id', 'p.name', 'x.team_id', 't.name', 'x.price', 'p.base_price', "case when x.\"type\" = 'sale' then x.reversed end", 'null', "strftime(x.ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'")} line
 from tx x left join who w on w.lot = x.sequence left join players p on p.player_id = w.player_id left join teams t on t.team_id = x.team_id""",
    "report_csv": f"""with {_POOL}, {_FRAN}, {_MONEY} select 0 part, m.team_id team_pos, player_id pos, {_line('m.team_id', 'm.name', 'p.name', 'role', "'SOLD'", 'price', 'sequence', 'initial_purse', 'spent', 'remaining')} line from pool p join money m on m.team_id = p.team_id
 union all select 1, null, player_id, {_line('null', 'null', 'name', 'role', "'UNSOLD'", 'null', 'sequence', 'null', 'null', 'null')} from pool where status = 'unsold'""",
    "report_json": f"""with {_POOL}, {_FRAN}, {_MONEY}, {_TX},
 squad as (select team_id, list({{'id': player_id, 'name': name, 'role': role, 'price': price, 'sequence': sequence}} order by player_id) members, {", ".join(f"count(*) filter (role = '{r}') {r}" for r in _ROLES)} from pool where status = 'sold' group by 1)
 select 'auction' section, '' "key", '{{"name":"Cup","status":"completed","currencySymbol":"₹","generatedAt":"2024-01-01T00:00:00.000Z"}}' json
 union all select 'summary', '', cast(json_object('teams', (select count(*) from fran where initial_purse > 0), 'players', count(*), 'sold', count(*) filter (status = 'sold'), 'unsold', count(*) filter (status = 'unsold'), 'totalExpenditure', cast(sum(price) as bigint), 'averageSalePrice', cast(floor(sum(price) / count(price) + 0.5) as bigint),
  'highestPricedPlayer', (select json_object('id', player_id, 'name', name, 'role', role, 'salePrice', price) from pool where status = 'sold' order by price desc, player_id limit 1)) as varchar) from pool
 union all select 'team', cast(m.team_id as varchar), cast(json_object('id', m.team_id, 'name', m.name, 'owner', '', 'initialPurse', initial_purse, 'spent', spent, 'remaining', remaining, 'squadSize', purchased, 'roleCounts', json_object({", ".join(f"'{r}', coalesce({r}, 0)" for r in _ROLES)}), 'squad', coalesce(members, [])) as varchar) from money m left join squad q on q.team_id = m.team_id
 union all select 'unsold', cast(player_id as varchar), cast(json_object('id', player_id, 'name', name, 'role', role, 'basePrice', base_price, 'sequence', sequence) as varchar) from pool where status = 'unsold'
 union all select 'transaction', cast(sequence as varchar), '{{"sequence":' || sequence || ',"type":"' || "type" || '"' || case when "type" = 'sale' then ',"team_id":' || team_id || ',"price":' || price else '' end || ',"reversed":' || reversed || '}}' from tx""",
    "first_devices": f"""with {_TEAMS}, {_ACT}, a as (select * from act where action = 'view' order by ts, event_id limit 8), r as (select *, case when actor % 10 = 0 then 'admin' when actor % 3 = 0 then 'team' else 'display' end role from a)
 select event_id, role, case role when 'admin' then 'Administrator' when 'team' then coalesce((select name from teams where team_id = actor * 11), 'Team dashboard') else 'Public display' end label from r""",
    "derived_ids": f"""with {_TX} select sequence, 'tx-' || left(sha256(sequence || chr(31) || "type"), 8) tx_id from tx""",
    "public_view": f"with {_FIN} select team_id, name, initial_purse, spent, remaining, purchased, team_id % 4 = 0 pin_required from fin",
    "masked_feed": f"""with {_FIN}, v as (select n_nationkey viewer_id, list_extract(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], n_nationkey % 5 + 1) "key", n_regionkey r from nation),
 x as (select viewer_id, "key", f.*, r = 0 or (r > 1 and viewer_id = f.team_id) sees from fin f join teams t on t.team_id = f.team_id join v on v."key" = t.owner)
 select viewer_id, "key", team_id, case when sees then initial_purse end initial_purse, case when sees then spent end spent, case when sees then remaining end remaining, case when sees then purchased end purchased from x""",
    "reconnect_replay": f"""with {_ACT}, l as (select actor "key", max(event_id) version from act group by 1) select "key", version, action, amount, 'r' || "key" reader_id from l join act on event_id = version where "key" % 3 = 0 or ("key" % 7 <> 0 and version >= "key")""",
    "active_team_sessions": f"""with {_TEAMS}, {_ACT}, l as (select e.event_id, e.actor, e.ts, max(s.ts) login from act e join act s on s.actor = e.actor and s.action = 'signup' and (s.ts < e.ts or (s.ts = e.ts and s.event_id <= e.event_id)) group by 1, 2, 3)
 select event_id, actor team_id from l where ts < login + interval 12 hours and actor in (select team_id from teams where initial_purse > 0)""",
    "display_texts": f"""with {_ACT} select event_id, action || ' was done' action_text, printf('%.1f KB', event_id / 2) size, case when event_id % 8 < 4 then true when event_id % 8 < 7 then false end switch, (event_id * 1000) || ': 50|*: ' || event_id tiers, event_id || ' x|' || action || '|' jar from act""",
    "csv_team_ingest": f"""with recursive {_TEAMS}, t as (select owner path, row_number() over (partition by owner order by team_id) rn, 't-' || (team_id % 700) id, 'Name ' || (team_id // 2 % 400) name, case when team_id % 17 <> 0 then team_id * 100 end purse, case when team_id % 19 = 0 then null else team_id % 2 <> 0 end active from teams),
 o as (select *, case when active is null then 'active is no boolean' when purse is null then 'bad purse' when id = 't-9' then 'duplicate id in the pool' when lower(name) = 'name 33' then 'duplicate name in the pool' end own from t),
 w as (select distinct path, 0::bigint rn, []::varchar[] ids, []::varchar[] names, null::varchar error from t
 union all select w.path, o.rn, case when e is null then list_append(ids, id) else ids end, case when e is null then list_append(names, name) else names end, e from w join o on o.path = w.path and o.rn = w.rn + 1,
 lateral (select coalesce(own, case when list_contains(ids, id) then 'duplicate id in the file' when list_contains(names, name) then 'duplicate name in the file' end) e))
 select t.path, cast(t.rn + 1 as integer) line, id team_id, name, cast(purse as bigint) initial_purse, active, error from t join w using (path, rn)""",
    "csv_ingest": f"""with {_PLAYERS}, r as (select category path, row_number() over (partition by category order by player_id) rn, 'p-' || (player_id % 1500) id, name, case when role in ('ECONOMY', 'SMALL') then 'Batter' when role = 'LARGE' then 'Bowler' when role = 'PROMO' then null else 'Wicketkeeper' end role, base_price from players),
 e as (select *, role is not null and id not in ('p-7', 'p-8') good, count(*) filter (role is not null and id not in ('p-7', 'p-8')) over (partition by path, id order by rn) nth from r)
 select path, cast(rn + 1 as integer) line, id player_id, name, role, base_price, case when role is null then 'unknown role' when not good then 'duplicate id in the pool' when nth > 1 then 'duplicate id in the file' end error from e""",
    "command_fold": _fold(),
}
