import pytest

from fenceline.operators.leases import GRACE, PROFILES, Command, Lock, transition
from fenceline.sources.stores import MemoryLeases, dialect, store

S = 1_000_000


@pytest.fixture(params=PROFILES)
def leases(request):
    made = MemoryLeases(request.param)
    made.seed("j", "r0", 0)
    return made


def test_first_acquisition_gives_token_1(leases):
    assert leases.acquire("j", "p", "c1", S, 10 * S)[0] == 1


def test_second_is_refused_while_held(leases):
    leases.acquire("j", "p", "c1", S, 10 * S)
    assert leases.acquire("j", "q", "c2", 2 * S, 10 * S) is None
    assert leases.token("j") == 1


def test_token_grows_with_every_acquisition(leases):
    tokens = []
    for n in range(5):
        token, _ = leases.acquire("j", "p", f"c{n}", (n + 1) * 10 * S, 5 * S)
        tokens.append(token)
        leases.release("j", token, (n + 1) * 10 * S + S)
    assert tokens == [1, 2, 3, 4, 5]


def test_expired_lease_can_be_taken_over_and_keeps_its_run(leases):
    _, run = leases.acquire("j", "p", "c1", S, 2 * S)
    token, again = leases.acquire("j", "q", "c2", 5 * S, 2 * S)
    assert (token, again) == (2, run)


def test_fresh_run_after_clean_release_at_once(leases):
    token, run = leases.acquire("j", "p", "c1", S, 10 * S)
    assert leases.release("j", token, 2 * S)
    assert leases.acquire("j", "p", "c2", 3 * S, 10 * S)[1] == "c2" != run


def test_renew_needs_the_token(leases):
    token, _ = leases.acquire("j", "p", "c1", S, 10 * S)
    assert leases.renew("j", token, 2 * S, 10 * S)
    assert not leases.renew("j", token + 1, 3 * S, 10 * S)


def test_lapsed_lease_is_not_revived(leases):
    token, _ = leases.acquire("j", "p", "c1", S, S)
    assert not leases.renew("j", token, 4 * S, 10 * S)
    assert leases.acquire("j", "q", "c2", 5 * S, S)


def test_zombie_cannot_release_or_renew(leases):
    old, _ = leases.acquire("j", "p", "c1", S, S)
    new, _ = leases.acquire("j", "q", "c2", 5 * S, 10 * S)
    assert not leases.release("j", old, 6 * S) and not leases.renew("j", old, 6 * S, S)
    assert leases.renew("j", new, 6 * S, S)


def test_release_frees(leases):
    token, _ = leases.acquire("j", "p", "c1", S, 100 * S)
    assert leases.release("j", token, 2 * S) and leases.acquire("j", "q", "c2", 3 * S, S)


def test_seed_is_idempotent(leases):
    leases.acquire("j", "p", "c1", S, 10 * S)
    assert not leases.seed("j", "other", 0) and leases.token("j") == 1


def test_unknown_job(leases):
    assert leases.acquire("none", "p", "c", 0, S) is None and leases.token("none") is None


def test_boundary_at_expiry():
    lock = Lock("HELD", 3, "p", "r", 0, 10 * S, True)
    for profile in ("as_built", "as_documented"):
        assert not transition(lock, Command("ACQUIRE", 10 * S), profile)[1]
        assert transition(lock, Command("RENEW", 10 * S), profile)[1]
        assert transition(lock, Command("ACQUIRE", 10 * S + 1), profile)[1]
        assert not transition(lock, Command("RENEW", 10 * S + 1), profile)[1]
    assert transition(lock, Command("ACQUIRE", 10 * S), "expiring")[1] and transition(lock, Command("RENEW", 10 * S), "expiring")[1]


def test_run_id_300_seconds_after_release():
    def again(profile, after):
        lock, _ = transition(Lock(run_id="seed"), Command("ACQUIRE", 0, ttl=300 * S, candidate="a"), profile)
        lock, _ = transition(lock, Command("RELEASE", S), profile)
        return transition(lock, Command("ACQUIRE", after, candidate="b"), profile)[0].run_id

    assert again("as_built", 300 * S) == "b" and again("as_built", 300 * S + 1) != "b"
    assert again("as_documented", 300 * S) == again("as_documented", 9999 * S) == "b"
    assert again("expiring", 9999 * S) == "b"


def test_expiring_row_is_gone_after_its_grace():
    lock, _ = transition(Lock(), Command("ACQUIRE", S, ttl=2 * S, candidate="a"), "expiring")
    late, _ = transition(lock, Command("ACQUIRE", lock.expires_at + GRACE + S, candidate="b"), "expiring")
    soon, _ = transition(lock, Command("ACQUIRE", lock.expires_at + GRACE, candidate="b"), "expiring")
    assert (soon.run_id, late.run_id, late.token) == ("a", "b", 2)


def test_pause_while_held():
    leases = MemoryLeases()
    leases.seed("j", "r", 0)
    token, _ = leases.acquire("j", "p", "c", S, 100 * S)
    assert leases.admin("j", "pause", 2 * S)
    assert not leases.renew("j", token, 3 * S, S) and not leases.release("j", token, 3 * S)
    assert leases.locks["j"].status == "PAUSED" and leases.acquire("j", "q", "c", 999 * S, S) is None
    assert transition(leases.locks["j"], Command("SAVE", 3 * S, token=token))[1]
    assert leases.admin("j", "resume", 1000 * S) and leases.acquire("j", "q", "c", 1001 * S, S)


def test_admin_errors_and_confirmation():
    leases = MemoryLeases()
    leases.seed("j", "r", 0)
    leases.acquire("j", "p", "c", S, S)
    with pytest.raises(ValueError):
        leases.admin("j", "explode", S)
    assert not leases.admin("j", "clear", S) and leases.token("j") == 1
    assert leases.admin("j", "clear", S, "new", confirm=True) and leases.token("j") == 0
    with pytest.raises(ValueError):
        leases.acquire("j", "p", "c", S, 999_999)
    with pytest.raises(ValueError):
        transition(Lock(), Command("DANCE", 0))


def test_one_winner_a_round(leases):
    for n in range(1, 201):
        won = [leases.acquire("j", f"p{i}", f"c{n}-{i}", n * 100 * S, 10 * S) for i in range(50)]
        assert sum(w is not None for w in won) == 1


def test_stores_and_dialects():
    assert [dialect(p) for p in ("PostgreSQL", "MariaDB 11", "MySQL", "Microsoft SQL Server", "Oracle", None)] == ["default", "mysql", "mysql", "mssql", "oracle", "default"]
    assert store("key-value")[0].profile == "expiring" and store("relational")[0].profile == "as_built"
    with pytest.raises(ValueError):
        store("paper")
    with pytest.raises(ValueError):
        MemoryLeases("other")
