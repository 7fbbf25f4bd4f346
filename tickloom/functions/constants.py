"""Fixed values of the measurement rules (they must stay as they are for equal results)."""

# --- fixed values ---------------------------------------------------------
TICK_POINTS = 5                      # price points per tick
BID, ASK, TRADE_SIDE = 0, 1, -1
CONTINUATION_CAP_MS = 100            # longest life of an open matching event
REFILL_WINDOWS_MS = (100, 1000, 5000)
DEFAULT_WINDOW_MS = 1000
TRADE_WINDOWS_MS = (10, 1)
BLOCK_MS = 300_000                   # five-minute block
HOUR_MS = 3_600_000
MINUTE_MS = 60_000
UTC_SHIFT_MS = -10_800_000           # exchange clock is UTC-3
# trading status: pre-open, open, closing call, closed, pause, no open
ST_PREOPEN, ST_OPEN, ST_CALL, ST_CLOSED, ST_PAUSE, ST_NO_OPEN = 21, 17, 101, 18, 2, 4
OPEN_GUARD_MS = 900_000              # 15 minutes after the open
CALL_GUARD_MS = 900_000              # 15 minutes before the closing call
AUCTION_GUARD_MS = 60_000            # 1 minute after each auction
MAX_STATE_GAP_MS = 2_000             # longer quiet gaps are not a spread state
RESIDUE_MESSAGES = 3                 # order messages after a print still adjacent to it
RUN_GAP_MS = 1_000                   # longest gap inside a cancel run
QUEUE_FRONT, QUEUE_BACK = 0.20, 0.80
# --- end of fixed values --------------------------------------------------

KEY = ["day", "sid"]
CHUNK = ["day", "sid", "chunk"]
