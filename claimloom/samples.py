"""Our own sample texts for queries and tests."""

LETTER_SUBJECT = "Compensation request, booking $PNR"

LETTER_TEMPLATE = """Dear $AIRLINE_NAME team,

my booking $PNR for flight $FLIGHT_NUMBER from $ORIGIN to $DESTINATION on \
$SCHEDULED_DEPARTURE was affected: $DISRUPTION_TYPE. I was told at $INTIMATION_TIME \
(notice: $NOTICE_WINDOW).

I ask for:
- $COMPENSATION_TYPE_1
- $COMPENSATION_TYPE_2
- expenses of $TOTAL_EXPENSES

$FULL_NAME
$EMAIL_ADDRESS
$PHONE_NUMBER
"""

FOLLOW_UPS = ["Write to the airline", "File with the regulator", "Download a report"]

CHAT_EXAMPLES = [("Hi", "Hello, what happened?"), ("My seat changed", "downgrade")]
