"""``python -m phenospark read|fit|evaluate|report|build|adapt|clusters``."""

from .plans.jobs import main

if __name__ == "__main__":
    main()
