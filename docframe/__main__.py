import sys

from docframe.cli import main

sys.exit(main())
