import sys

from .plans.search import main

sys.exit(main(sys.argv[1:]))
