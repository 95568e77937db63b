"""Sentences that events are told in, so that every pattern of the library meets messages: (role, text).

{k} stands for the event's number, {p} for a file of its user.
"""

USER, ASSISTANT = "user", "assistant"

SENTENCES = [
    # errors
    (USER, 'Traceback (most recent call last):\n  File "/srv/app/main.py", line {k}\nValueError: cannot parse field {k}  \n'),
    (USER, "KeyError: missing key name{k} in /etc/app/settings.json"),
    (USER, "TimeoutException: no answer after {k} ms at 2024-01-02T03:04:05Z"),
    (USER, "error[E0382]: borrow of moved value item{k}"),
    (USER, "error TS2345: argument {k} has the wrong type"),
    (USER, "it failed to compile the module\nerror: missing semicolon near token {k}"),
    (USER, "Error: connection refused by 0xdeadbeef on attempt {k}"),
    (USER, "FAILED: step {k} of the nightly import"),
    # solutions
    (ASSISTANT, "The solution was: restart the worker and clear cache {k}"),
    (ASSISTANT, "To fix: remove the stale lock file number {k} first"),
    (ASSISTANT, "You should: upgrade the driver to release {k} soon"),
    # decisions
    (ASSISTANT, "Decision: Use the columnar storage layer for archive {k}"),
    (ASSISTANT, "ADR: Keep one database per tenant in stage {k}"),
    (ASSISTANT, "For the record, the test coverage goal is {k} percent"),
    (ASSISTANT, "Policy: Tokens expire after {k} minutes of idle time"),
    (ASSISTANT, "Going forward, caching happens at the edge in zone {k}"),
    (ASSISTANT, "I decided to split the parser into {k} smaller steps."),
    (ASSISTANT, "We decided to follow the naming convention of team {k}."),
    (ASSISTANT, "I recommend using a message broker with {k} partitions."),
    (ASSISTANT, "We should use the approach from release {k}."),
    # names
    (USER, "Hello there, my name is Alice."),
    (USER, "Hi, I'm Bruno, nice to meet you"),
    (USER, "you can call me Carla please"),
    (USER, "i am Dmitri from the ops team"),
    (USER, "I'm working on the importer now"),
    (USER, "Have a look at it when there is time.\nCheers,\nElena"),
    # preferences
    (USER, "My coding style is short functions everywhere"),
    (USER, "We always write strict mode"),
    (USER, "Never use console.log in here"),
    (USER, "I use pnpm"),
    (USER, "Just run pytest on it"),
    (USER, "We use neovim mostly"),
    (USER, "This is using fastapi already"),
    (USER, "I usually like to write tests first"),
    (USER, "Always run tests before push"),
    (USER, "We practice tdd"),
    (USER, "Please be concise"),
    (USER, "No emojis in answers"),
    (USER, "Show me code first"),
    (USER, "Please don't ask too many questions"),
    (USER, "Explain as you go"),
    (USER, "I prefer step by step"),
    (USER, "Commit often"),
    (USER, "I'll commit on my own"),
    (USER, "Please run tests after that"),
    (USER, "What did you change"),
    (USER, "Proceed without asking"),
    (USER, "Be autonomous"),
    (USER, "Land the fleet near sector {k} and never use var"),
    # rules
    (USER, "I never commit secrets into branch release{k}"),
    (USER, "We always review migrations twice before rollout"),
    (USER, "You must validate every incoming payload carefully"),
    (USER, "Stop adding global state everywhere please"),
    (USER, "I'd rather keep modules small and focused"),
    (USER, "Use ruff instead of flake8"),
    (USER, "Format with black"),
    (USER, "We use google style"),
    (USER, "Please avoid nested callbacks"),
    (USER, "I typically squash commits while merging"),
    (USER, "When working on exporters, always keep column order stable"),
    (USER, "For python files, use typed signatures everywhere"),
    (USER, "With sqlalchemy, prefer explicit session scopes"),
    (USER, "We always review migrations twice before every rollout"),
    (USER, "According to them they always skip every review step"),
    (USER, "Should we always review migrations twice?"),
    (USER, "Ignore what I said about review migrations twice rollout"),
    (USER, "I changed my mind about nested callbacks"),
    # zones
    (USER, "There is an issue with {p} again"),
    (ASSISTANT, "`{p}` keeps failing today, line {k}"),
    (USER, "Be careful with {p} from now on"),
    (ASSISTANT, "See the documentation on issue in {p}"),
    # prerequisites
    (USER, "In codespaces, I need to start tailscaled with `sudo tailscaled` because the network is closed."),
    (USER, "On wsl, run the docker daemon first."),
    (USER, "When using podman, the local registry must be running"),
    (ASSISTANT, "The staging server requires redis to be running."),
    (USER, "Remember to connect the vpn on gitpod"),
    (USER, "Always launch postgres when on linux"),
    (USER, "First step on kubernetes is to login into the registry."),
    (ASSISTANT, "nginx doesn't start automatically in docker"),
    # accomplishments and outcomes
    (ASSISTANT, 'Ran git commit -m "Add parser for field {k}"'),
    (ASSISTANT, "\u2705 Import of table {k} is done"),
    (ASSISTANT, "\u2713 schema checked for run {k}"),
    (ASSISTANT, "Fixed: the race in worker {k} shutdown. The bug is fixed"),
    (ASSISTANT, "Implemented: retries with backoff in client {k}"),
    (ASSISTANT, "Now created the index for shard {k}. All tests passed"),
    (ASSISTANT, "Completed: the migration of tenant {k}"),
    (ASSISTANT, "So {k} tests passed"),
    (ASSISTANT, "We released v1.{k}.0 and bumped to 2.{k}.1"),
    (ASSISTANT, "The importer for batch {k} is now working. More next week"),
    # facts
    (ASSISTANT, "This call is deprecated since release {k} of the client."),
    (ASSISTANT, "Callers must always close the cursor of pool {k}."),
    (ASSISTANT, "A signed header is required for route {k}."),
    (ASSISTANT, "The approach is simple and covers case {k} well."),
    (ASSISTANT, "Let me check whether a signed header is required here."),
    # concepts
    (ASSISTANT, "Redis is used for caching the sessions of node {k}. The auth service handles logins of all users."),
    (ASSISTANT, "The search backend provides ranked results. Postgres is here to hold orders."),
    # topics, tasks, ways of working
    (USER, "Good morning, back to the importer"),
    (USER, "Please can you help me fix the scheduler in {p}"),
    (USER, "Could you plan the design of exporter {k}?"),
    (USER, "Implement the retry queue and edit the docs"),
    (USER, "Verify that it works, then push it"),
    (USER, "Let's switch to something else, write test cases for edit {k}"),
    # artifacts
    (ASSISTANT, "Here:\n```Python\nimport os\nprint(os.getcwd(), {k})\n```\nThat is it"),
    (ASSISTANT, "Plan:\n1. read the file {k}\n2. parse it\n3. write it\n"),
    (ASSISTANT, "Parts:\n- reader {k}\n- parser\n- writer\n"),
    (ASSISTANT, "| name | size |\n|------|------|\n| a{k} | 1 |\n"),
    (ASSISTANT, '{"name": "job{k}", "retries": 3}'),
    (ASSISTANT, "See https://docs.site.org/guide/{k} and https://docs.site.org/reference/{k}/index"),
    (ASSISTANT, "def load{k}(path): from \"fastcsv/reader\" import rows; Error: timeout in src/load.py"),
]
